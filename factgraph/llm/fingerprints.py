"""Document fingerprints: a Merkle tree over paragraphs and sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factgraph.llm.common import documents

#: Leaves of a paragraph: runs of up to 96 characters that end with their sentence, so that an edit within a long
#: paragraph can be located, and likeness is not all or nothing. They leave nothing out.
LEAF = r"[^.!?\n]{1,96}[.!?]*|[.!?\n]+"


def merkle(text: Column) -> Column:
    """struct(root, sections, leaves): the tree of a text.

    Sections are split at blank lines, paragraphs at line ends, and paragraphs into leaves. A leaf's node is the SHA-256
    of its text, a paragraph's that of its leaves' nodes, a section's that of its paragraphs' nodes, the root that of the
    sections' nodes. Splitting loses nothing, so equal roots mean equal texts. `leaves` are 64-bit hashes of the distinct
    leaves: comparing them takes linear time, where looking for equal branches by name would not.
    """
    over = lambda parts: F.sha2(F.array_join(parts, ""), 256)
    pieces = F.transform(F.split(text, "\n\n"), lambda s: F.transform(F.split(s, "\n"), lambda p: F.regexp_extract_all(p, F.lit(LEAF), F.lit(0))))
    paragraphs = lambda s: F.transform(s, lambda p: over(F.transform(p, lambda leaf: F.sha2(leaf, 256))))
    leaves = lambda all_: F.array_distinct(F.transform(F.flatten(F.flatten(all_)), lambda p: F.xxhash64(p)))
    tree = F.transform(F.array(pieces), lambda t: F.struct(F.transform(t, paragraphs).alias("paragraphs"), leaves(t).alias("leaves")))
    sections = lambda ps: F.transform(ps, lambda p: F.struct(over(p).alias("node"), p.alias("paragraphs")))
    tree = F.transform(tree, lambda t: F.struct(sections(t["paragraphs"]).alias("sections"), t["leaves"].alias("leaves")))
    return F.transform(tree, lambda t: F.struct(over(t["sections"]["node"]).alias("root"), t["sections"].alias("sections"), t["leaves"].alias("leaves")))[0]


def likeness(a: Column, b: Column) -> Column:
    """1 for equal roots, else the share of distinct leaves that two trees have in common (Jaccard)."""
    both = F.size(F.array_intersect(a["leaves"], b["leaves"]))
    either = F.size(a["leaves"]) + F.size(b["leaves"]) - both
    return F.when(a["root"] == b["root"], 1.0).when(either == 0, 0.0).otherwise(both / either)


def first_unequal(a: Column, b: Column) -> Column:
    """Place, from 1, of the first element in which two arrays differ; 0 if none."""
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.size(a), F.size(b), F.lit(1))), lambda i: ~F.get(a, i - 1).eqNullSafe(F.get(b, i - 1)))
    return F.coalesce(F.get(at, F.lit(0)), F.lit(0))


def first_difference(a: Column, b: Column) -> Column:
    """struct(section, paragraph), from 1: down the first branch whose nodes differ; zeros for equal trees."""
    section = first_unequal(a["sections"]["node"], b["sections"]["node"])
    within = lambda t, k: F.coalesce(F.get(t["sections"]["paragraphs"], k - 1), F.array().cast("array<string>"))
    down = lambda k: F.struct(k.alias("section"), F.when(k == 0, 0).otherwise(first_unequal(within(a, k), within(b, k))).alias("paragraph"))
    return F.transform(F.array(section), down)[0]


def with_next_text(docs: DataFrame, out: str = "next_text", rows_per_bucket: int = 20_000) -> DataFrame:
    """(doc_id, text, next_text): each row with the text of the next row by ascending id; after the last comes the first.

    Ids are cut into ranges at approximate quantiles, 256 to 65,536 of them, which come to the driver; only a range is
    ever ordered in one place. The first row of each range is also dealt to the range before it, so that one shuffle of
    the texts is all. Rows that share an id, or have none, follow one another by text; they lie in one range, and all
    rows with the first id of a range are dealt twice. A table of one row gives that row's own text, an empty one nothing.
    """
    spark = docs.sparkSession
    buckets = min(max(256, docs.count() // rows_per_bucket), 1 << 16)
    marks = docs.agg(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)], 20 * buckets)).first()[0] or []
    marks = sorted(set(marks))
    steps = []
    while sum(steps) < len(marks):
        steps.insert(0, 1 << len(steps))
    bounds = F.lit([*marks, *[(1 << 63) - 1] * (sum(steps) + 1 - len(marks))]).cast("array<bigint>")

    def bucket(key: Column) -> Column:
        """How many marks are not above the key, by binary search."""
        if not steps:
            return F.lit(0)
        down = lambda at, s: F.when(F.get(bounds, at + s - 1) <= key, at + s).otherwise(at)
        return F.least(F.aggregate(F.lit(steps), F.lit(0), down), F.lit(len(marks)))

    order = ["wrap", F.col("doc_id").asc_nulls_first(), "text"]
    keyed = docs.withColumn("bucket", F.when(F.col("doc_id").isNull(), 0).otherwise(bucket(F.col("doc_id")))).withColumn("wrap", F.lit(0))
    firsts = keyed.groupBy("bucket").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("has"), "doc_id", F.xxhash64("text"))).alias("f")).collect()
    firsts = sorted((r["bucket"], r["f"]["doc_id"]) for r in firsts)
    if not firsts:
        return docs.withColumn(out, F.col("text"))
    heads = spark.createDataFrame(
        [(b, i, firsts[k - 1][0], int(k == 0)) for k, (b, i) in enumerate(firsts)], "b int, i bigint, before int, wraps int"
    )
    guests = keyed.join(F.broadcast(heads), (F.col("bucket") == F.col("b")) & F.col("doc_id").eqNullSafe(F.col("i")))
    dealt = keyed.select("doc_id", "text", "bucket", "wrap", F.lit(True).alias("own")).unionByName(
        guests.select("doc_id", "text", F.col("before").alias("bucket"), F.col("wraps").alias("wrap"), F.lit(False).alias("own"))
    )
    # A guest in its own bucket (when there is one bucket only) follows every row; elsewhere ids already place it last.
    following = F.lead("text").over(Window.partitionBy("bucket").orderBy(*order, F.col("own").desc()))
    return dealt.withColumn(out, following).where("own").select("doc_id", "text", out)


def edit_tail(text: Column, donor: Column) -> Column:
    """The last quarter of the characters replaced by as many of the donor's first ones (or all it has)."""
    n = F.char_length(text)
    cut = F.floor(n / 4).cast("int")
    return F.concat(F.left(text, n - cut), F.left(donor, cut))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and `tree` (see merkle) of every document.

    A null text counts as empty; the empty text has a tree of one empty paragraph; equal texts have equal trees;
    repeated rows give repeated results; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn("tree", merkle(F.col("text")))


def op3_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trees of each document and of its edited text. Null texts count as empty; repeated rows are edited with the next
    row of the order in with_next_text; equal texts have equal fingerprints; an empty table gives an empty result."""
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    pairs = with_next_text(docs).withColumn("edited", edit_tail(F.col("text"), F.col("next_text")))
    trees = pairs.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        F.transform(F.array("text", "edited", "next_text"), merkle).alias("trees"),
    )
    own, edited, following = (F.col("trees")[k] for k in range(3))
    return trees.select(
        "doc_id", "n_chars", "edited_sha256", own["root"].alias("fingerprint"), edited["root"].alias("edited_fingerprint"),
        likeness(own, edited).alias("near_edited"), likeness(own, following).alias("near_next"),
        F.size(own["sections"]).alias("n_sections"), F.size(own["leaves"]).alias("n_leaves"),
        first_difference(own, edited).alias("edit"),
    ).select("*", F.col("edit.section").alias("edited_section"), F.col("edit.paragraph").alias("edited_paragraph")).drop("edit")


def tree_sql(text: str, name: str) -> str:
    """The tree of a text in DuckDB: (doc_id, root, nodes, paragraphs, leaves)."""
    over = lambda parts: f"sha256(array_to_string({parts}, ''))"
    leaves = f"list_transform(string_split(s, chr(10)), lambda p: regexp_extract_all(p, '{LEAF}'))"
    return f"""{name}_pieces as (select doc_id, list_transform(string_split({text}, chr(10)||chr(10)), lambda s: {leaves}) as pieces from pairs),
{name}_parts as (select doc_id, list_transform(pieces, lambda s: list_transform(s, lambda p: {over("list_transform(p, lambda x: sha256(x))")})) as paragraphs, list_distinct(flatten(flatten(pieces))) as leaves from {name}_pieces),
{name}_nodes as (select *, list_transform(paragraphs, lambda s: {over("s")}) as nodes from {name}_parts),
{name} as (select *, {over("nodes")} as root from {name}_nodes)"""


def near_sql(a: str, b: str) -> str:
    both = f"len(list_intersect({a}.leaves, {b}.leaves))"
    either = f"(len({a}.leaves) + len({b}.leaves) - {both})"
    return f"case when {a}.root = {b}.root then 1.0::double when {either} = 0 then 0.0::double else {both}::double / {either} end"


def unequal_sql(a: str, b: str) -> str:
    return f"coalesce(list_filter(range(1, greatest(len({a}), len({b}), 1) + 1), lambda i: {a}[i] is distinct from {b}[i])[1], 0)::int"


#: For tables whose ids are unique. Leaves are compared by their texts.
SQL = f"""with docs as (select doc_id, coalesce(text, '') as text from documents),
ahead as (select doc_id, text, coalesce(lead(text) over (order by doc_id), first_value(text) over (order by doc_id)) as following from docs),
pairs as (select *, left(text, (length(text) - length(text) // 4)::int)||left(following, (length(text) // 4)::int) as edited from ahead),
{tree_sql("text", "own")}, {tree_sql("edited", "new")}, {tree_sql("following", "other")},
placed as (select p.doc_id, length(p.text) as n_chars, sha256(edited) as edited_sha256, own.root as fingerprint, new.root as edited_fingerprint, {near_sql("own", "new")} as near_edited, {near_sql("own", "other")} as near_next,
 len(own.nodes)::int as n_sections, len(own.leaves)::int as n_leaves, {unequal_sql("own.nodes", "new.nodes")} as edited_section, own.paragraphs as a, new.paragraphs as b
 from pairs p join own on own.doc_id = p.doc_id join new on new.doc_id = p.doc_id join other on other.doc_id = p.doc_id),
branches as (select *, case when edited_section = 0 then [] else coalesce(a[edited_section], []) end as x, case when edited_section = 0 then [] else coalesce(b[edited_section], []) end as y from placed)
select doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_sections, n_leaves, edited_section, case when edited_section = 0 then 0 else {unequal_sql("x", "y")} end as edited_paragraph from branches"""
