"""Math rules: one case for each, balance, depth, and a table read from JSON."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from papyra.functions import texmath
from papyra.functions.texmath import normal_math

CASES = [
    (r"\mathds{R} x", r"\mathbb{R}x"), (r"\vvmathbb R", r"\mathbb{R}"), (r"\mathbbm 1+x", r"\mathbb{1}+x"), (r"\wideparen{AB}", r"\overset{\frown}{AB}"),
    (r"\cancelto {0}{x}", r"\overset{0}{x}"), (r"\ensuremath{a}", "a"), (r"\mathlarger{a\mathsmaller{b}}", "ab"), (r"\rotatebox{90}{x}", "x"), (r"\scalebox{2}{y}", "y"),
    (r"\resizebox{1pt}{2pt}{z}", "z"), (r"\multicolumn{2}{c}{w}", "w"), (r"\pmatrix{a&b}", r"\begin{pmatrix}a&b\end{pmatrix}"), (r"\textsc{abc}", r"\text{ABC}"),
    (r"\mbox{if $x>0$ or \$5}", r"\text{if }x>0\text{ or \$5}"), (r"\mbox{}", ""), (r"\mbox{open", r"\mbox{open"), (r"\raisebox{1pt}[2pt][3pt]{$x$}", "x"), (r"\raisebox{1pt}{ab}", "ab"),
    (r"a\coloneqq b\eqqcolon c", r"a:= b\mathrel{=:} c"), (r"\buildrel {d} \over {=}", r"\overset{d}{=}"), (r"\expectationvalue{a_{1}}", r"\left\langle a_{1} \right\rangle"),
    (r"\begin{bmatrix}[cc]a\end{bmatrix}", r"\begin{bmatrix}a\end{bmatrix}"), (r"\begin{array}[] {cc}a\end{array}", r"\begin{array}{cc}a\end{array}"),
    (r"\begin{split}a\end{split}", r"\begin{aligned}a\end{aligned}"), (r"\begin{eqnarray*}a\end{eqnarray*}", r"\begin{aligned}a\end{aligned}"), (r"\begin{equation}a\end{equation}", "a"),
    (r"\big{(}x\Biggr {\}}", r"\big(x\Biggr\}"), (r"\big{ab}", r"\big{ab}"), (r"{\rm abc} + {\bf x}", r"\mathrm{abc} + \mathbf{x}"), (r"\text{\it  ab }", r"\textit{ab}"), (r"{\rm a{b}}", r"{\rm a{b}}"),
    (r"a\mspace{3mu}b\strut c\xspace\protect d", "ab c d"), (r"x\label{eq:{1}}\cref{a}", "x"), (r"\eqref{a} \ref{b}", r"(\text{?}) \text{?}"), (r"\iddots\vline", r"\ddots|"),
    (r"a\hline\cr b", r"a\\ b"), (r"\cmidrule[2pt]{1-2}\cline{1-2}a", "a"), (r"a\hfill\dotfill\hrulefill b", "a b"), (r"a\\[2pt]b\\ \\c", r"a\\b\\c"), (r"a\cr b", r"a\\ b"),
    (r"a\nopagebreak[4]\linebreak b", "a b"), ("a%\nb%\r\nc\\%\nd", "abc\\d"), (r"\displaystyle x", "x"), (r"\labels{x} \crx \{ \}", r"\labels{x} \crx \{ \}"), (r"}a{", "}a{"),
    (r"\cancelto{a} b", r"\cancelto{a} b"), (r"\mbox{\mathds{R}}", r"\text{\mathbb{R}}"), ("", ""), ("\\", "\\"),
]


@pytest.mark.parametrize(("tex", "want"), CASES)
def test_rule(tex, want):
    assert normal_math(tex) == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["{", "}", "\\mbox", "\\cancelto", "\\label", "\\begin", "{split}", "a", " ", "\\\\", "\\", "$", "[2]", "\\raisebox", "\\big", "\\frac"]), max_size=14))
def test_any_text_ends(parts):
    tex = "".join(parts)
    once = normal_math(tex)
    assert isinstance(once, str) and once.count("{") - once.count("}") <= tex.count("{")


def test_depth_and_null():
    n = 20_000
    assert normal_math(r"\ensuremath{" * n + "x" + "}" * n) == "x" and normal_math("{" * n) == "{" * n and normal_math(None) is None
    assert normal_math(r"\ensuremath{" * 3000 + "x") == r"\ensuremath{" * 3000 + "x"


def test_table(spark, tmp_path):
    path = tmp_path / "rules.json"
    path.write_text('{"command_group_rules": [{"commands": ["twice", "double"], "group_count": 1, "strategy": "template", "replacement": "#1#1"}, {"commands": ["bold"], "group_count": 1, "strategy": "unwrap"}, {"commands": ["second"], "group_count": 2, "strategy": "keep_arg", "keep_arg_index": 1}]}')
    rules = texmath.read_rules(spark, f"file://{path}")
    rows = spark.createDataFrame([(r"\twice{a\bold{b}} \second{x}{y} \strut",), (None,)], "tex string")
    assert [r[0] for r in rows.select(texmath.math(F.col("tex"), rules)).collect()] == ["ababy", None]
    with pytest.raises(ValueError, match="unknown strategy"):
        texmath.rules_of('{"command_group_rules": [{"commands": ["a"], "group_count": 1, "strategy": "guess"}]}')
