"""Operator 10: canonical exact digests.

A text's canonical form is its NFKC normalisation with cases folded (normalised once
more) and runs of white space made one space, none at the ends. Its bucket is a pair
of 64-bit xxhashes of that form. Inside a bucket of several rows the forms' bytes are
compared; should they differ, each form gets a number that its fingerprint carries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvloom.llm.shared import checkpoint, only_marked

#: Ids of one cell, which one task orders, as a power of two; three levels of cells and the rest make up a long.
CELL_BITS = 16
LEVELS = 3
SEEDS = (0, 0x5EED)


def canonical(text: Column) -> Column:
    """NFKC, case folding and white-space folding; the library that Spark itself collates with does the first two."""
    compose = lambda c: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    fold = lambda c: F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), c, F.lit(True))
    return F.trim(F.regexp_replace(compose(fold(compose(text))), r"(?U)\s+", " "))


def _quarter() -> Column:
    """Code points of a text that the next document's take the place of."""
    return F.floor(F.length("text") / 4).cast("int")


def wide_hash(form: Column) -> list[Column]:
    return [F.xxhash64(F.lit(seed), form) for seed in SEEDS]


def _digest(text: Column, name: str, exact: bool) -> Column:
    """The bucket of a text; if exact, also what tells the forms of a bucket apart."""
    parts = lambda c: [h.alias(f"h{i}") for i, h in enumerate(wide_hash(c))] + ([F.sha2(c, 256).alias("sha")] if exact else [])
    return F.transform(F.array(canonical(text)), lambda c: F.struct(*parts(c)))[0].alias(name)


def next_ids(ids: DataFrame) -> DataFrame:
    """(id, next) for distinct longs ``id``: the next larger one, and the smallest after the largest; null is the smallest of all.

    Ids are ordered within cells of 2 ** CELL_BITS values; the last of a cell is followed by the
    first of the next cell, which the cells' own cells tell, so no task orders more than a cell.
    """

    def following(df: DataFrame, level: int) -> DataFrame:
        """df: (key, first). Adds next: the first of the next key; null after the last."""
        if level == LEVELS:
            return df.withColumn("next", F.lead("first").over(Window.orderBy(F.asc_nulls_first("key"))))
        df = df.withColumn("cell", F.shiftright("key", CELL_BITS))
        inside = df.withColumn("next", F.lead("first").over(Window.partitionBy("cell").orderBy(F.asc_nulls_first("key"))))
        cells = following(df.groupBy("cell").agg(F.min("first").alias("first")).withColumnRenamed("cell", "key"), level + 1)
        cells = cells.select(F.col("key").alias("__cell"), F.col("next").alias("__next"))
        joined = inside.join(cells, F.col("cell").eqNullSafe(F.col("__cell")), "left")
        return joined.select("key", "first", F.coalesce("next", "__next").alias("next"))

    out = following(ids.select(F.col("id").alias("key"), F.col("id").alias("first")), 0)
    # the one that has nothing after it: two numbers come to the driver
    least, none = ids.agg(F.min("id"), F.max(F.col("id").isNull())).first()
    return out.select(F.col("key").alias("id"), F.coalesce("next", F.lit(None if none else least).cast("long")).alias("next"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of each row.

    The edited text ends in the next document's beginning instead of its own last quarter.
    Likeness is 1 for equal canonical forms and 0 otherwise. A null text is empty. Rows
    with one id have the same next document, and the next one is, of the rows with its id, the
    one whose needed beginning and digest are the smallest. A null id comes before all others.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ids = base.groupBy(F.col("doc_id").alias("id")).agg(F.max(_quarter()).alias("need"))
    follow = next_ids(ids.select("id")).withColumnRenamed("id", "of")
    wanted = checkpoint(follow.join(ids, F.col("of").eqNullSafe(F.col("id"))).select("of", "next", "need"))
    digests = checkpoint(_digests(base, wanted, exact=False))
    numbers = _numbers(digests, base, wanted)
    if numbers is not None:
        digests = _digests(base, wanted, exact=True)
    for side in ("own", "other", "following"):
        digests = _named(digests, side, numbers)
    like = lambda a, b: (F.col(a) == F.col(b)).cast("double")
    return digests.select(
        "doc_id",
        "n_chars",
        F.lower(F.hex("edited_sha")).alias("edited_sha256"),
        F.col("name_own").alias("fingerprint"),
        F.col("name_other").alias("edited_fingerprint"),
        like("name_own", "name_other").alias("near_edited"),
        like("name_own", "name_following").alias("near_next"),
    )


def _edited(base: DataFrame, wanted: DataFrame, exact: bool) -> DataFrame:
    """base with edited, and following: the digest of the next document."""
    following = _digest(F.col("text"), "following", exact)
    heads = base.join(wanted, F.col("doc_id").eqNullSafe(F.col("next"))).select("of", F.expr("substring(text, 1, need)").alias("head"), following)
    heads = heads.groupBy("of").agg(F.min(F.struct("head", "following")).alias("least"))
    joined = base.join(heads, F.col("doc_id").eqNullSafe(F.col("of")), "left")
    begin = F.col("text").substr(F.lit(1), F.length("text") - _quarter())
    return joined.select("doc_id", "text", F.concat(begin, F.col("least.head").substr(F.lit(1), _quarter())).alias("edited"), F.col("least.following").alias("following"))


def _digests(base: DataFrame, wanted: DataFrame, exact: bool) -> DataFrame:
    return _edited(base, wanted, exact).select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.unhex(F.sha2("edited", 256)).alias("edited_sha"),
        _digest(F.col("text"), "own", exact),
        _digest(F.col("edited"), "other", exact),
        "following",
    )


def _numbers(digests: DataFrame, base: DataFrame, wanted: DataFrame) -> DataFrame | None:
    """(h0, h1, sha, number) of the forms in buckets that hold several; None if, as ever, there are none.

    Only rows in buckets of several rows are read again, and their forms compared as bytes:
    the smallest and the largest of a bucket, which tasks find before they shuffle.
    """
    sides = F.explode(F.array("own", "other")).alias("d")
    several = digests.select(sides).groupBy("d.h0", "d.h1").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h0", "h1")
    ids = digests.select("doc_id", sides).select("doc_id", "d.h0", "d.h1").join(several, ["h0", "h1"], "left_semi").select(F.col("doc_id").alias("id")).distinct()
    ids = checkpoint(ids)
    wanted = wanted.join(ids, F.col("of").eqNullSafe(F.col("id")), "left_semi")
    base = only_marked(base, "doc_id", ids.union(wanted.select("next")))
    again = _edited(base, wanted, False).join(ids, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    again = again.select(F.explode(F.array("text", "edited")).alias("t")).select(canonical(F.col("t")).alias("form"))
    h0, h1 = wide_hash(F.col("form"))
    forms = again.select(h0.alias("h0"), h1.alias("h1"), "form")
    mixed = forms.groupBy("h0", "h1").agg(F.min("form").alias("a"), F.max("form").alias("b")).where(F.col("a") != F.col("b")).select("h0", "h1")
    mixed = checkpoint(mixed)
    if mixed.isEmpty():
        return None
    ranked = forms.join(mixed, ["h0", "h1"], "left_semi").distinct()
    rank = F.dense_rank().over(Window.partitionBy("h0", "h1").orderBy("form")) - 1
    return checkpoint(ranked.select("h0", "h1", F.sha2("form", 256).alias("sha"), rank.alias("number")))


def _named(digests: DataFrame, side: str, numbers: DataFrame | None) -> DataFrame:
    """Adds the fingerprint of a digest: its bucket, and the form's number there if there are several."""
    name = F.concat(*[F.lower(F.lpad(F.hex(F.col(f"{side}.h{i}")), 16, "0")) for i in range(len(SEEDS))])
    if numbers is None:
        return digests.withColumn(f"name_{side}", name)
    keys = [F.col(f"{side}.{k}") == F.col(f"__{k}") for k in ("h0", "h1", "sha")]
    renamed = numbers.select(*[F.col(k).alias(f"__{k}") for k in ("h0", "h1", "sha", "number")])
    joined = digests.join(renamed, keys, "left")
    named = F.when(F.col("__number").isNotNull(), F.concat_ws("-", name, F.col("__number").cast("string"))).otherwise(name)
    return joined.withColumn(f"name_{side}", named).drop("__h0", "__h1", "__sha", "__number")
