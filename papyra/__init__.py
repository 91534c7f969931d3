"""papyra: document and paper-library analytics as composable Spark DataFrame functions."""
