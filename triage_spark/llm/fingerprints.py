"""Closed-syncmer fingerprints, built from DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

K = 3  # words of a k-mer
S = 1  # words of its inner substring


FEW = 16  # common hashes that are looked for one by one
LONG_WORD = 16  # characters; a longer word (a script without spaces, say) is taken character by character


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def hashes_of(words: Column) -> Column:
    """64-bit hashes of words, in order, and of the characters of words over LONG_WORD. `words` is read more than once: let it be a column that is made already."""
    letters = F.filter(F.flatten(F.transform(words, lambda w: F.when(F.char_length(w) > LONG_WORD, F.split(w, "")).otherwise(F.array(w)))), lambda w: w != "")
    return F.transform(F.when(F.exists(words, lambda w: F.char_length(w) > LONG_WORD), letters).otherwise(words), lambda w: F.xxhash64(w))


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the lower-cased words, in order, and of the characters of words over LONG_WORD; no words: an empty array."""
    return hashes_of(words_of(text))


def add_anchors(df: DataFrame, text: str, out: str, k: int = K, s: int = S) -> DataFrame:
    """Add `out`: the closed syncmers of a text as array<struct<hash, pos>>, in text order.

    A k-mer of words is kept if the least hash of its k-s+1 inner s-mers lies at its first or last place.
    That depends on the k-mer's words alone, so an anchor survives every edit that does not touch it.
    A text of fewer than k words, or with none kept, has one anchor: its whole word sequence at 0 (an empty
    or null text: that of the empty sequence).
    """
    h, m = f"{out}_words__", f"{out}_inner__"
    df = df.withColumn(h, words_of(F.coalesce(F.col(text), F.lit(""))))  # a step of its own, so that the text is cut once
    df = df.withColumn(h, hashes_of(F.col(h)))
    if s > 1:
        inner = F.expr(f"transform(sequence(0, greatest(size({h}) - {s}, 0)), i -> xxhash64(slice({h}, i + 1, {s})))")
        df = df.withColumn(m, inner)
    else:
        df = df.withColumn(m, F.col(h))
    w = k - s + 1
    # the edges against the least of the places between them, place by place: no slice is built for k-mers that fall
    between = [f"get({m}, i + {j})" for j in range(1, w - 1)]
    least = between[0] if len(between) == 1 else f"least({', '.join(between)})"
    edge = f"least(get({m}, i), get({m}, i + {w - 1})) <= {least}" if between else "true"
    kept = F.expr(f"if(size({h}) >= {k}, filter(sequence(0, greatest(size({h}) - {k}, 0)), i -> {edge}), cast(array() AS array<int>))")
    df = df.withColumn(f"{out}_at__", kept)
    kmer = ", ".join(f"get({h}, i + {j})" for j in range(k))
    anchors = F.expr(f"transform({out}_at__, i -> struct(xxhash64({kmer}) AS hash, i AS pos))")
    whole = F.expr(f"array(struct(xxhash64({h}) AS hash, 0 AS pos))")
    df = df.withColumn(out, F.when(F.size(f"{out}_at__") > 0, anchors).otherwise(whole))
    return df.drop(h, m, f"{out}_at__")


def fingerprint_text(anchors: Column) -> Column:
    """A fingerprint as text: all distinct anchor hashes in order, eight bytes each (the most significant first), in base64.

    Nothing is left out, so two fingerprints are equal only for equal anchor sets, and the likeness can be had from them alone.
    """
    hashes = F.transform(F.sort_array(F.array_distinct(anchors["hash"])), lambda h: F.lpad(F.hex(h), 16, "0"))
    return F.replace(F.base64(F.unhex(F.array_join(hashes, ""))), F.lit("\r\n"), F.lit(""))  # whether Spark breaks lines is a setting


def add_likeness(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """Add `out`: the share of distinct anchors that two anchor columns have in common, 0 to 1: exact, however many there are."""
    both = F.size(F.array_intersect(F.col(a)["hash"], F.col(b)["hash"]))
    return df.withColumn(out, both / F.size(F.array_union(F.col(a)["hash"], F.col(b)["hash"])))


def match_positions(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """Add `out` (offset, anchors): the offset, b's place less a's in words, on which most anchors agree, and how many do.

    Of an anchor that repeats in a text the first place counts. Both texts' anchors are sorted together by hash, a's places from
    the last to the first and then b's from the first to the last, so that the two first places of a common one stand side by side; then
    the offsets are sorted and the longest run of equal ones is taken: no step looks at all pairs. Where at most FEW hashes are
    common, only their anchors are sorted. Rows without a common anchor get null; ties go to the least offset.
    """
    d = df.withColumn("common__", F.array_intersect(F.col(a)["hash"], F.col(b)["hash"]))
    few = lambda c: F.when(F.size("common__") > FEW, F.col(c)).otherwise(F.filter(c, lambda x: F.array_contains("common__", x["hash"])))
    side = lambda c, place: F.transform(few(c), lambda x: F.struct(x["hash"].alias("hash"), place(x["pos"]).alias("place")))
    all_ = F.sort_array(F.concat(side(a, lambda p: -1 - p), side(b, lambda p: p)))
    d = d.withColumn("all__", F.when(F.size("common__") > 0, all_))
    meet = "filter(sequence(1, size(all__) - 1), i -> get(all__, i).place >= 0 AND get(all__, i - 1).place < 0 AND get(all__, i).hash = get(all__, i - 1).hash)"
    d = d.withColumn("offsets__", F.sort_array(F.transform(F.expr(meet), lambda i: F.get("all__", i)["place"] + F.get("all__", i - 1)["place"] + 1)))
    d = d.withColumn("starts__", F.expr("filter(sequence(0, size(offsets__) - 1), i -> i = 0 OR get(offsets__, i) <> get(offsets__, i - 1))"))
    runs = "transform(starts__, (s, i) -> struct(coalesce(get(starts__, i + 1), size(offsets__)) - s AS anchors, -get(offsets__, s) AS back))"
    d = d.withColumn("run__", F.array_max(F.expr(runs)))
    return d.withColumn(out, F.when(F.size("common__") > 0, F.struct((-F.col("run__.back")).alias("offset"), F.col("run__.anchors")))).drop("common__", "all__", "offsets__", "starts__", "run__")


def with_next(docs: DataFrame, columns: list[str], key: str = "doc_id", n_buckets: int | None = None) -> DataFrame:
    """Add `next_<c>` for each column: the row after this one by key; after the last comes the first.

    Rows are dealt to ranges of the key by approximate quantiles (their number bounds what the driver holds)
    and each range gets a copy of the first row of the range after it, so the values cross the shuffle once.
    Null keys come first; rows with one key are ordered by the first column's hash. A single row follows itself.
    Keys are whole numbers (any other type is an error).
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType
    if not isinstance(kind, T.IntegralType):
        raise ValueError(f"{key} must be of whole numbers to have a next row, not {kind.simpleString()}")
    n = n_buckets or min(4096, int(spark.conf.get("spark.sql.shuffle.partitions")))
    q = [i / n for i in range(1, n)] or [0.5]
    cuts = sorted(set(docs.select(F.percentile_approx(F.col(key), q, 100 * n)).first()[0] or []))
    bucket = F.lit(0)
    if cuts:
        # binary search in the literal array of cuts: the number of cuts at or below the key
        steps = len(cuts).bit_length()
        array = "array(" + ",".join(f"{c}L" for c in cuts) + ")"
        bucket = F.expr(
            f"aggregate(sequence(1, {steps}), named_struct('lo', 0, 'hi', {len(cuts)}), (r, i) -> if(r.lo >= r.hi, r,"
            f" if(get({array}, (r.lo + r.hi) div 2) <= {key}, named_struct('lo', cast((r.lo + r.hi) div 2 + 1 AS int), 'hi', r.hi),"
            f" named_struct('lo', r.lo, 'hi', cast((r.lo + r.hi) div 2 AS int)))), r -> if({key} IS NULL, 0, r.lo))"
        )
    keyed = docs.withColumn("bucket__", bucket)
    tie = F.xxhash64(columns[0])
    least = F.min(F.struct(F.col(key).isNotNull().alias("known"), F.col(key).alias("key"), tie.alias("tie")))
    firsts = keyed.groupBy("bucket__").agg(least.alias("f")).orderBy("bucket__").collect()
    if not firsts:
        return docs.select("*", *[F.col(c).alias(f"next_{c}") for c in columns])
    own = keyed.withColumn("last__", F.lit(0))
    before = {f["bucket__"]: firsts[i - 1]["bucket__"] for i, f in enumerate(firsts)}
    rows = [(before[f["bucket__"]], f["f"]["key"], f["f"]["tie"]) for f in firsts]
    wanted = spark.createDataFrame(rows, f"to__ int, key__ {kind.simpleString()}, tie__ bigint")
    ids = [r[1] for r in rows if r[1] is not None]
    pruned = docs.filter(F.col(key).isin(ids) | F.col(key).isNull()) if ids else docs.filter(F.col(key).isNull())
    heads = pruned.join(F.broadcast(wanted), F.col(key).eqNullSafe(F.col("key__")) & (tie == F.col("tie__"))).dropDuplicates(["to__"])
    heads = heads.select(*docs.columns, F.col("to__").alias("bucket__"), F.lit(1).alias("last__"))
    w = Window.partitionBy("bucket__").orderBy("last__", F.asc_nulls_first(key), tie)
    both = own.unionByName(heads)
    led = both.withColumn("led__", F.lead(F.struct(*columns)).over(w)).filter("last__ = 0")
    return led.select(*docs.columns, *[F.col("led__")[c].alias(f"next_{c}") for c in columns])


def fingerprint_with_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint every whole text, and the text whose last half gives way to the start of the next one.

    The last floor(n/2) code points are replaced by as many first ones (or all) of the next text by key. Null texts
    count as empty, repeated rows follow one another, an empty table gives no rows; other columns are not read,
    whatever their names. Only the text crosses the shuffle; anchors are made after it, of both texts and of the edited one.

    Returns key, n_chars, text, edited_text, anchors, edited_anchors (array<struct<hash, pos>>), near_edited, near_next, and
    match_edited, match_next (offset and number of the anchors that agree on it).
    """
    base = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("text"))
    d = with_next(base, ["text"], key).withColumn("n_chars", F.char_length("text").cast("long"))
    d = d.withColumn("edited_text", F.expr("concat(substring(text, 1, int(n_chars - n_chars div 2)), substring(next_text, 1, int(n_chars div 2)))"))
    for of, out in (("text", "anchors"), ("edited_text", "edited_anchors"), ("next_text", "next_anchors")):
        d = add_anchors(d, of, out)
    for other, name in (("edited_anchors", "edited"), ("next_anchors", "next")):
        d = match_positions(add_likeness(d, "anchors", other, f"near_{name}"), "anchors", other, f"match_{name}")
    return d.drop("next_text", "next_anchors")
