"""Cards, glossaries and references over texts made from parts and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyra.operators import cards, linking
from papyra.operators.tables import dealt
from papyra.plans.registry import query

PARTS = "p AS (SELECT p_partkey, p_brand, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b, upper(p_name[1]) || lower(p_name[2:]) AS n, upper(p_type[1]) || lower(p_type[2:]) AS t FROM part)"
NAMED = f"{PARTS}, q AS (SELECT *, upper(a[1]) || a[2:] || ' ' || upper(b[1]) || b[2:] || ' ' || t AS full_form, upper(a[1] || b[1] || t[1]) AS short, upper(a[1]) || a[2:] || upper(b[1]) || b[2:] AS joined FROM p)"


def introductions(t):
    """Parts as paragraphs that spell a name out, with its initials, and use a compound; every seventh is code."""
    full = F.concat_ws(" ", F.initcap("p_name"), F.initcap("p_type"))
    initials = F.array_join(F.transform(F.split(full, " "), lambda w: F.substring(w, 1, 1)), "")
    text = F.concat(F.lit("Using the *"), full, F.lit("* ("), initials, F.lit("), with "), F.replace(F.initcap("p_name"), F.lit(" "), F.lit("")), F.lit(" by `Code Name (CN)`, Smith2020."))
    return dealt(t("part")).select("p_brand", F.concat(F.lit("p-"), F.col("p_partkey").cast("string")).alias("uid"), F.col("p_partkey").alias("place"), F.when(F.col("p_partkey") % 7 == 0, "code").otherwise("paragraph").alias("kind"), text.alias("text"))


@query(f"""WITH {NAMED}, c AS (
  SELECT p_brand, short || '::' || lower(full_form) AS key, 'abbreviation_pair' AS kind, short AS anchor, full_form AS title, short AS abbreviation, full_form, p_partkey FROM q
  UNION ALL SELECT p_brand, 'term::' || lower(short), 'acronym_or_dataset', short, short, NULL, short, p_partkey FROM q WHERE short NOT IN ('AND', 'ARE', 'FIG', 'FOR', 'HAS', 'IMG', 'NOT', 'OUR', 'SEC', 'THE')
  UNION ALL SELECT p_brand, 'term::' || lower(joined), 'method_name', joined, joined, NULL, joined, p_partkey FROM q),
f AS (SELECT p_brand, key, any_value(kind) AS kind, any_value(anchor) AS anchor, any_value(title) AS title, any_value(abbreviation) AS abbreviation, any_value(full_form) AS full_form, count(*) AS uses, count(DISTINCT p_partkey) AS blocks FROM c WHERE p_partkey % 7 > 0 GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY abbreviation IS NULL, uses DESC, lower(title))::INTEGER AS rank FROM f""")
def reader_cards(t):
    """Terms that paragraphs introduce, folded by key, in the order of cards."""
    rows = cards.reader_cards(introductions(t), "p_brand", "uid", "place", "kind", "text")
    return rows.withColumn("blocks", F.size("uids").cast("long")).drop("uids")


def instructions(t):
    """Parts as texts that name them outside and within code and formulas, whole and as a part of other words."""
    name, last = F.col("p_name"), F.substring_index("p_name", " ", -1)
    text = F.concat(F.lit("Take the "), name, F.lit(", `"), name, F.lit("`, $"), name, F.lit("$, "), last, F.lit("-like "), F.upper(last), F.lit(" or "), last, F.lit("s."))
    return dealt(t("part")).select("p_partkey", text.alias("text"))


def glossary(t):
    """Names and their last words with targets; a name's target holds its last word, which is a term itself."""
    name, last = F.col("p_name"), F.substring_index("p_name", " ", -1)
    names = t("part").select(name.alias("source"), F.concat(F.lit("new "), last).alias("target"))
    return names.unionByName(t("part").select(last.alias("source"), F.concat(F.lit("<"), F.upper(last), F.lit(">")).alias("target"))).distinct()


@query(f"WITH {PARTS} SELECT p_partkey, 'Take the new <' || upper(b) || '>, `' || a || ' ' || b || '`, $' || a || ' ' || b || '$, ' || b || '-like <' || upper(b) || '> or ' || b || 's.' AS text FROM p")
def glossary_table(t):
    """A table of terms applied to texts, the longest first, outside code and formulas."""
    return linking.glossary_applied(instructions(t), glossary(t), "p_partkey", "text")


@query(f"WITH {PARTS} SELECT p_partkey, 'Take the new <' || upper(b) || '>, `' || a || ' ' || b || '`, $' || a || ' ' || b || '$, ' || b || '-like <' || upper(b) || '> or ' || b || 's.' AS text FROM p")
def glossary_joined(t):
    """The same where the table is too large to be broadcast: texts and terms meet by first words."""
    return linking.glossary_applied(instructions(t), glossary(t), "p_partkey", "text", most=0)


@query(f"WITH {PARTS}, s AS (SELECT DISTINCT a || ' ' || b AS source FROM p UNION SELECT DISTINCT b FROM p), x AS (SELECT p_partkey, 'Take the ' || a || ' ' || b || ', `' || a || ' ' || b || '`, $' || a || ' ' || b || '$, ' || b || '-like ' || upper(b) || ' or ' || b || 's.' AS text FROM p) SELECT p_partkey, source FROM x JOIN s ON regexp_matches(lower(text), '(^|[^a-z0-9_-])' || source || '($|[^a-z0-9_-])')")
def glossary_mentions(t):
    """Terms of a table that texts hold whole."""
    return linking.mentions(instructions(t), glossary(t), "p_partkey", "text")


@query(f"WITH {PARTS} SELECT p_brand, count(*) AS affected FROM p JOIN (SELECT p_partkey FROM part WHERE p_partkey % 3 > 0) v USING (p_partkey) WHERE a || ' ' || b IN (SELECT p_name FROM part WHERE p_size > 25) GROUP BY 1")
def glossary_affected(t):
    """Default renderings of another glossary version whose text holds an active term, by brand."""
    active = t("part").where("p_size > 25").select(F.col("p_name").alias("source")).distinct()
    hit = linking.mentions(instructions(t), active, "p_partkey", "text").select("p_partkey").distinct()
    variants = t("part").where("p_partkey % 3 > 0").select("p_partkey", "p_brand")
    return variants.join(hit, "p_partkey", "left_semi").groupBy("p_brand").agg(F.count(F.lit(1)).alias("affected"))


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderkey % 9 + 1 AS n, o_orderkey % 2 = 0 AS has_table FROM orders)
SELECT k AS page_id, 'p' || k AS uid, 'As [Figure ' || n || '](#F' || n || ') and ' || CASE WHEN has_table THEN '[Table ' || n || '](#T' || n || ')' ELSE 'Table ' || n END || ' show [\\[' || n || '\\]](#bib' || n || '), 77, so does Figure ' || n || '0; see [section ' || n || '](#S' || n || ') and Fig. ' || n || '.' AS text FROM o""")
def linked_references(t):
    """References in texts as links to the blocks and citations that their pages have."""
    k = F.col("o_orderkey")
    n = (k % 9 + 1).cast("string")
    orders = t("orders").select(k.alias("page_id"), F.concat(F.lit("p"), k.cast("string")).alias("uid"), n.alias("n"), (k % 2 == 0).alias("has_table"))
    say = lambda *xs: F.concat(*[F.col("n") if x is None else F.lit(x) for x in xs])
    blocks = orders.select("page_id", "uid", say("As Figure ", None, " and Table ", None, " show [", None, ", 77], so does Figure ", None, "0; see section ", None, " and Fig. ", None, ".").alias("text"))
    named = F.array(*[F.struct(F.lit(p).alias("place"), F.concat(F.lit(h), F.col("n")).alias("href"), F.col("n").alias("label")) for p, h in enumerate(("#F", "#T", "#bib", "#S", "#none"))])
    refs = orders.select("page_id", "uid", F.inline(named))
    kinds = F.array(*[F.struct(F.concat(F.lit(h), F.col("n")).alias("href"), F.lit(x).alias("kind")) for h, x in (("#F", "figure"), ("#T", "table"), ("#bib", "citation"), ("#S", "section"))])
    targets = orders.select("page_id", "has_table", F.inline(kinds)).where("has_table OR kind <> 'table'").drop("has_table")
    return linking.linked(blocks, refs, targets, ["page_id", "uid"], "text")
