"""Line dedup by a log-template tree, in DataFrame operations only.

A line's fields that hold a digit are variable and become <*>, and its white space single spaces.  The tree has a fixed depth: token count, then the first
LEAD tokens; a line's leaf is the hash of both.  A leaf may hold several templates.  A token is general at its position if
more than half of the leaf's lines have it there, and common if at least MIN_DOCS lines have.  A line of which at least
SIMILAR of the positions are general belongs to the leaf's general template; of the others a line of which as many are
general or common has the template that is left when its other tokens become <*>; any other line is its own template.

A template that is in at least MIN_DOCS documents is a candidate.  Candidates that follow each other in a document are a
run and share its surroundings: the leaves of the lines before and after the run, or, where the run is the whole
document, the run's own templates.  A template recurs if it is in at least MIN_DOCS different surroundings, however often
each occurs.  Lines that repeat only because whole documents are copied have one, so they are left to near-dedup.  All
occurrences of recurring templates are dropped.  Blank lines are kept and count neither as lines nor as surroundings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small, stored

LEAD = 3
SIMILAR = 0.7
CONSTANT = 0.5
MIN_DOCS = 10
FIELD = r"(?<!\S)[^\s0-9]*+[0-9]\S*+"


def _doc() -> Column:
    return F.xxhash64("doc_id", "text")


def _lines() -> Column:
    """The lines that are not blank: at (from 0) and words, the line with single spaces and masked fields."""
    masked = F.when(F.col("text").rlike("[0-9]"), F.regexp_replace("text", FIELD, "<*>")).otherwise(F.col("text"))
    plain = F.when(masked.rlike(r"[^\S\n ]|  "), F.regexp_replace(masked, r"[^\S\n]+", " ")).otherwise(masked)
    return F.filter(F.transform(F.split(plain, "\n"), lambda line, i: F.struct(i.alias("at"), F.trim(line).alias("words"))), lambda x: x["words"] != "")


def _leaf(words: Column) -> Column:
    return F.xxhash64(F.length(words) - F.length(F.replace(words, F.lit(" "))), F.substring_index(words, " ", LEAD))


def parsed(docs: DataFrame) -> DataFrame:
    """A row per line that is not blank: doc (hash of id and text), at, i (its number among these lines), template and leaf
    (hashes), before and after (the leaves of its neighbours)."""
    rows = docs.where("text is not null").select(_doc().alias("doc"), _lines().alias("lines"))
    rows = rows.withColumn("leaves", F.transform("lines", lambda x: _leaf(x["words"])))
    leaf = lambda i: F.get("leaves", i)
    each = F.transform("lines", lambda x, i: F.struct(x["at"].alias("at"), i.alias("i"), F.xxhash64(x["words"]).alias("template"), leaf(i).alias("leaf"), leaf(i - 1).alias("before"), leaf(i + 1).alias("after")))
    return rows.select("doc", F.explode(each).alias("x")).select("doc", "x.*")


def _candidates(lines: DataFrame, key: str) -> DataFrame:
    """The keys that are in enough documents."""
    return lines.groupBy(key).agg(F.countDistinct("doc").alias("docs")).where(F.col("docs") >= MIN_DOCS).select(key)


def _recurring(hits: DataFrame) -> DataFrame:
    """The keys of hits (all lines of candidates) that are in enough surroundings."""
    of_doc = Window.partitionBy("doc").orderBy("i")
    runs = hits.withColumn("run", F.col("i") - F.row_number().over(of_doc)).groupBy("doc", "run").agg(
        F.min_by("before", "i").alias("before"), F.max_by("after", "i").alias("after"),
        F.bit_xor(F.xxhash64("key", "i")).alias("templates"), F.collect_set("key").alias("keys"),
    )
    whole = F.col("before").isNull() & F.col("after").isNull()
    side = lambda c: F.coalesce(c, F.lit(-1).cast("long"))
    around = F.when(whole, F.xxhash64(F.lit("whole"), "templates")).otherwise(F.xxhash64(side("before"), side("after")))
    counted = runs.select(F.explode("keys").alias("key"), around.alias("around")).groupBy("key").agg(F.countDistinct("around").alias("arounds"))
    return counted.where(F.col("arounds") >= MIN_DOCS).select("key")


def busy_leaves(lines: DataFrame) -> DataFrame:
    """leaf: those with two templates or more, and in enough documents for a template of several to recur."""
    kinds = lines.groupBy("leaf").agg(F.count("*").alias("n"), F.min("template").alias("a"), F.max("template").alias("b"))
    kinds = stored(kinds.where((F.col("n") >= MIN_DOCS) & (F.col("a") != F.col("b"))).select("leaf"), "leaf-kinds")
    return _candidates(lines.join(small(kinds), "leaf", "left_semi"), "leaf")


def generalised(docs: DataFrame, leaves: DataFrame) -> DataFrame:
    """template and general: the key of the template of several that a template belongs to, for those of leaves that do."""
    leaves = small(leaves)
    words = docs.where("text is not null").select(F.explode(_lines()).alias("x")).select(F.col("x.words").alias("words"))
    there = words.withColumn("leaf", _leaf(F.col("words"))).join(leaves, "leaf", "left_semi")
    kinds = stored(there.groupBy("leaf", "words").agg(F.count("*").alias("n")), "line-kinds")
    totals = small(stored(kinds.groupBy("leaf").agg(F.sum("n").alias("total")), "leaf-totals"))
    tokens = kinds.select("leaf", "n", F.xxhash64("words").alias("template"), F.posexplode(F.split("words", " ")).alias("pos", "token"))
    counts = tokens.groupBy("leaf", "pos", "token").agg(F.sum("n").alias("of")).join(totals, "leaf")
    general = F.col("of") > CONSTANT * F.col("total")
    counts = counts.where(general | (F.col("of") >= MIN_DOCS)).select("leaf", "pos", "token", general.alias("is_general"))
    marked = tokens.drop("n").join(small(stored(counts, "line-tokens")), ["leaf", "pos", "token"], "left")
    shown = F.struct("pos", F.when(F.col("is_general").isNotNull(), F.col("token")).otherwise("<*>").alias("shown"))
    each = marked.groupBy("leaf", "template").agg(
        F.count("*").alias("size"), F.count_if("is_general").alias("general"), F.count("is_general").alias("common"), F.sort_array(F.collect_list(shown)).alias("shown")
    )
    of_leaf, enough = F.col("general") >= SIMILAR * F.col("size"), F.col("common") >= SIMILAR * F.col("size")
    key = F.when(of_leaf, F.col("leaf")).otherwise(F.xxhash64(F.lit("<*>"), F.array_join(F.col("shown.shown"), " ")))
    return each.where(of_leaf | enough).select("template", key.alias("general"))


def dropped(docs: DataFrame) -> DataFrame:
    """doc and ats: the line numbers (from 0) that recur, for the documents that have any."""
    lines = stored(parsed(docs), "lines")
    general = stored(generalised(docs, stored(busy_leaves(lines), "leaves")), "general")
    # A template is one row here, and few are general: the lines' own keys stay unless a join finds another.
    keyed = lines.join(small(general), "template", "left").withColumn("key", F.coalesce("general", "template"))
    candidates = stored(_candidates(keyed, "key"), "candidates")
    hits = stored(keyed.join(small(candidates), "key", "left_semi").select("doc", "at", "i", "key", "before", "after"), "hits")
    hits = hits.join(small(stored(_recurring(hits), "recurring")), "key", "left_semi")
    return hits.groupBy("doc").agg(F.collect_set("at").alias("ats"))


def cleaned(docs: DataFrame) -> DataFrame:
    """docs, all columns and rows kept, their texts without the recurring lines; n_chars, where it is a column, follows.

    Texts that are null or empty stay as they are; a text of which every line recurs becomes empty.  Rows that repeat a
    document are one document in the counts, and both are cleaned.
    """
    def free(name: str) -> str:
        return name if name.lower() not in map(str.lower, docs.columns) else free("_" + name)

    doc, ats = free("_doc"), free("_ats")
    gone = small(stored(dropped(docs).select(F.col("doc").alias(doc), F.col("ats").alias(ats)), "dropped-lines"))
    joined = docs.withColumn(doc, _doc()).join(gone, doc, "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains(ats, i)), "\n")
    text = F.when(F.col(ats).isNull(), F.col("text")).otherwise(kept)
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col(ats).isNull(), F.col("n_chars")).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType)
    return joined.withColumns(new).select(*docs.columns)


def line_counts(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines and n_dropped (lines that are not blank), and the cleaned text of each row."""
    lines = lambda c: F.coalesce(F.size(F.filter(F.split(c, "\n"), lambda x: F.trim(x) != "")), F.lit(0)).cast("long")
    out = cleaned(docs.select("doc_id", "text", lines("text").alias("n_lines")))
    return out.select("doc_id", "n_lines", (F.col("n_lines") - lines("text")).alias("n_dropped"), "text")
