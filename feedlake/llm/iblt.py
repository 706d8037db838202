"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, in DataFrame functions alone.

A text's sentences are its lines, cut at every sentence mark (in scripts beyond Cyrillic at any
punctuation); what is still long is cut at commas, then after words, and a long word after pairs of
characters, that a hash chooses. A paragraph is a run of sentences. At level 0 each sentence is one; at level
l a paragraph ends where a sentence's hash is a multiple of 2^l. A text's level follows its number of
sentences, so that a short text keeps all its cuts and a long one has ``MOST`` paragraphs at most on average.
Where to cut depends on the sentence at hand alone, so an edit moves no cut of another paragraph, and
the cuts of a level are among those of every lower one: two texts are compared on the higher level.

Each distinct paragraph's 64-bit digest enters one cell in each third of the sketch. A cell keeps a
count, the digests' exclusive or, and their checks' exclusive or. A third has as many cells as the
least power of two that is twice the number of digests or more. The fingerprint is that sketch, cell by cell.

Sketches are linear. Subtracting one version's from another's leaves the digests in which they differ,
and peeling recovers them: a cell with count one or minus one whose check fits holds a single digest,
which is taken out of its other cells, and so on. Two fingerprints of one size and level are subtracted
as they are returned; else the one of the shorter text is made anew at the size and level of the other.
Cells are rows, and all rows of a document lie in one partition, so subtracting and every round of peeling
is an aggregation without a shuffle, and only cells that hold something are rows. A round peels one third
of the cells: a digest has one cell there, so it is found once. A pair whose cells do not empty is
retried with sketches two, four and eight times as large; what even then does not empty, such as two digests of
equal cells in all sizes, is compared by its digests, so the likeness is always that of the digests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable

MOST = 32
LEAST_THIRD = 8
SALT = 100
ROUNDS = 8
LARGER = (2, 4, 8)
MOST_BUCKETS = 65_536
BUCKET_DOCS = 64
TASK_ROWS = 1000


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


# Sentence marks, and the punctuation of scripts beyond Cyrillic.
_ENDS = r"[.!?\n[\u0580-\uffff&&\p{Po}]]+\s*"
_COMMAS = r"[,;:]\s*"
LONG, LONG_WORD = 160, 32


def _chosen(key: Column, one_in: int) -> Column:
    return F.pmod(key, F.lit(one_in)) == 0


def _cut_word(word: Column) -> Column:
    """A word with a line end after each pair of characters that its hash chooses, about one in 16."""
    return _let(F.split(word, ""), lambda chars: F.array_join(F.transform(chars, lambda c, i: F.when(_chosen(F.xxhash64(F.get(chars, i - 1), c), 16), F.concat(c, F.lit("\n"))).otherwise(c)), ""))


def _cut_long(part: Column) -> Column:
    """Pieces of a long part: cut after each word that its hash chooses, about one in eight, and within long words."""

    def word(w: Column) -> Column:
        return F.when(F.char_length(w) > LONG_WORD, _cut_word(w)).when(_chosen(F.xxhash64(w), 8), F.concat(w, F.lit("\n"))).otherwise(w)

    return F.split(F.array_join(F.transform(F.split(part, r"\s+"), word), " "), r"\n\s*")


def _cut(parts: Column, how) -> Column:
    """Parts with the long ones among them cut."""
    return _let(parts, lambda p: F.when(F.exists(p, lambda x: F.char_length(x) > LONG), F.flatten(F.transform(p, lambda x: F.when(F.char_length(x) > LONG, how(x)).otherwise(F.array(x))))).otherwise(p))


def sentences(text: Column) -> Column:
    """Hashes of a text's sentences in order; none for a blank text."""
    parts = _cut(_cut(F.split(text, _ENDS), lambda x: F.split(x, _COMMAS)), _cut_long)
    return F.transform(F.filter(parts, lambda p: F.trim(p) != ""), lambda p: F.xxhash64(p))


def level(hashes: Column) -> Column:
    """The level of a text with these sentences."""
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.lit(1), F.size(hashes)) / MOST))).cast("int")


def paragraphs(hashes: Column, level: Column) -> Column:
    """Distinct digests of the paragraphs that sentences form on a level.

    Columns that ``level`` is made of must not share a name with an alias of the same select: within
    the lambda the planner would take the alias.
    """
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), level) - 1
    last = F.size(hashes) - 1
    start = F.struct(F.array().cast("array<bigint>").alias("done"), F.lit(0).cast("bigint").alias("open"), F.lit(0).alias("n"))

    def step(acc: Column, h: Column) -> Column:
        own = F.xxhash64(acc["open"], h)
        ends = (h.bitwiseAND(mask) == 0) | (acc["n"] == last)
        return F.struct(F.when(ends, F.concat(acc["done"], F.array(own))).otherwise(acc["done"]).alias("done"), F.when(ends, F.lit(0).cast("bigint")).otherwise(own).alias("open"), (acc["n"] + 1).alias("n"))

    return F.array_distinct(F.when(level == 0, hashes).otherwise(F.aggregate(hashes, start, step)["done"]))


def third(n: Column) -> Column:
    """Cells in a third of the sketch of ``n`` digests: a power of two, twice ``n`` or more."""
    return F.call_function("shiftleft", F.lit(1), F.ceil(F.log2(F.greatest(F.lit(LEAST_THIRD), n * 2))).cast("int"))


def _check(key: Column) -> Column:
    return F.xxhash64(key, F.lit(77)).bitwiseAND(F.lit(0xFFFFFFFF))


def _totals(cells: DataFrame) -> DataFrame:
    summed = cells.groupBy("row", "pair", "third", "cell").agg(F.sum("n").alias("n"), F.bit_xor("k").alias("k"), F.bit_xor("h").alias("h"), F.sum("more").alias("more"), F.sum("less").alias("less"))
    return summed.where("cell < 0 or n <> 0 or k <> 0 or h <> 0")


def _cell(cell: Column, n: Column, k: Column, h: Column, more: Column, less: Column) -> Column:
    return F.struct(cell.cast("int").alias("cell"), n.cast("long").alias("n"), k.alias("k"), h.alias("h"), more.cast("long").alias("more"), less.cast("long").alias("less"))


def _signed(digests: str, sign: int) -> Column:
    return F.transform(digests, lambda k: F.struct(k.alias("k"), F.lit(sign).alias("s")))


def _spot(key: Column, j: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(SALT + j)), F.col("third")) + F.col("third") * j


def cells(entries: DataFrame) -> DataFrame:
    """Cells that hold something, by row, pair, third and cell, of ``entries`` with row, pair, third, k and s."""
    told = entries.select("row", "pair", "third", "k", "s", _check(F.col("k")).alias("h"), F.explode(F.array(*(_spot(F.col("k"), j).cast("int") for j in range(3)))).alias("cell"))
    summed = told.groupBy("row", "pair", "third", "cell").agg(F.sum("s").alias("n"), F.bit_xor("k").alias("k"), F.bit_xor("h").alias("h"))
    return summed.where("n <> 0 or k <> 0 or h <> 0")


def subtract_and_peel(rows: DataFrame, rounds: int = ROUNDS, larger: int = 1) -> DataFrame:
    """Per ``row`` and ``pair``: how many digests only ``x`` has (``more``), only ``y`` (``less``), and whether cells are ``left``.

    ``rows`` holds row, pair and the digest arrays x and y, with all rows of a document in one partition.
    Pairs without any difference have no row. Sketches are ``larger`` times as large as the texts' own.
    """
    size = (third(F.greatest(F.size("x"), F.size("y"))) * larger).alias("third")
    signed = F.concat(_signed("x", 1), _signed("y", -1))
    now = cells(rows.select("row", "pair", size, F.explode(signed).alias("e")).select("row", "pair", "third", "e.k", "e.s")).withColumns({"more": F.lit(0).cast("long"), "less": F.lit(0).cast("long")})
    zero, none = F.lit(0), F.lit(0).cast("long")
    k, n, h = F.col("k"), F.col("n"), F.col("h")
    for r in range(rounds):
        j = r % 3
        pure = (F.floor(F.col("cell") / F.col("third")) == j) & (F.abs(n) == 1) & (h == _check(k))
        taken = [_cell(F.lit(-1), zero, none, none, (n > 0).cast("int"), (n < 0).cast("int"))]
        taken += [_cell(_spot(k, i), -n, k, h, zero, zero) for i in range(3) if i != j]
        kept = F.array(_cell(F.col("cell"), n, k, h, F.col("more"), F.col("less")))
        now = _totals(now.select("row", "pair", "third", F.explode(F.when(pure, F.array(*taken)).otherwise(kept)).alias("c")).select("row", "pair", "third", "c.*"))
    return now.groupBy("row", "pair").agg(F.sum("more").alias("more"), F.sum("less").alias("less"), F.max(F.col("cell") >= 0).alias("left"))


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows by number over enough tasks: cells take far more room than rows."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(tasks, -(-rows.count() // TASK_ROWS)), "row")


def likeness(rows: DataFrame, **pairs: tuple[str, str]) -> DataFrame:
    """row and each named pair's shared part of distinct paragraphs, 1 for two blank texts, of ``rows``, which has a unique column ``row``."""
    both = F.explode(F.array(*(F.struct(F.lit(p).alias("pair"), F.col(x).alias("x"), F.col(y).alias("y")) for p, (x, y) in enumerate(pairs.values()))))
    asked = rows.select("row", both.alias("p")).select("row", "p.*")
    met = asked.join(subtract_and_peel(asked), ["row", "pair"], "left").withColumn("left", F.coalesce("left", F.lit(False)))
    met = durable(met.select("row", "pair", F.when(F.col("left"), F.col("x")).alias("x"), F.when(F.col("left"), F.col("y")).alias("y"), "left", F.size("x").alias("n"), "more", "less"), "peeled")
    found, open_ = [met.where("not left").select("row", "pair", "n", "more", "less")], met.where("left").select("row", "pair", "x", "y", "n")
    for larger in LARGER:  # few pairs come here
        again = open_.repartition("row").join(subtract_and_peel(open_.repartition("row"), larger=larger), ["row", "pair"], "left").withColumn("left", F.coalesce("left", F.lit(False)))
        again = durable(again, f"peeled-{larger}")
        found.append(again.where("not left").select("row", "pair", "n", "more", "less"))
        open_ = again.where("left").select("row", "pair", "x", "y", "n")
    only = [F.size(F.array_except("x", "y")).cast("long").alias("more"), F.size(F.array_except("y", "x")).cast("long").alias("less")]
    found.append(open_.select("row", "pair", "n", *only))
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    union = F.col("n") + F.coalesce("less", F.lit(0))
    share = F.when(union == 0, F.lit(1.0)).otherwise((F.col("n") - F.coalesce("more", F.lit(0))) / union)
    return every.groupBy("row").agg(*(F.max(F.when(F.col("pair") == p, share)).alias(name) for p, name in enumerate(pairs)))


def fingerprints(rows: DataFrame, **columns: str) -> DataFrame:
    """row and, under each name, the sketch of a column's digests as text: cells in a third, a colon, then in base64 each cell that holds something.

    A cell is 17 bytes: its number (3), its count (2), its digests' exclusive or (8) and their checks' (4).
    Equal digests give equal fingerprints; no digest gives that of the empty sketch.
    """
    both = F.explode(F.array(*(F.struct(F.lit(p).alias("pair"), F.col(x).alias("x")) for p, x in enumerate(columns.values()))))
    wide = rows.select("row", both.alias("p")).select("row", "p.*")
    held = cells(wide.select("row", "pair", third(F.size("x")).alias("third"), F.explode(_signed("x", 1)).alias("e")).select("row", "pair", "third", "e.k", "e.s"))
    text = F.concat(F.lpad(F.hex("cell"), 6, "0"), F.lpad(F.hex("n"), 4, "0"), F.lpad(F.hex("k"), 16, "0"), F.lpad(F.hex("h"), 8, "0"))
    shown = held.select("row", "pair", "third", text.alias("c")).groupBy("row", "pair").agg(F.concat(F.first("third").cast("string"), F.lit(":"), F.base64(F.unhex(F.array_join(F.sort_array(F.collect_list("c")), "")))).alias("shown"))
    empty = F.lit(f"{LEAST_THIRD}:")
    return shown.groupBy("row").agg(*(F.coalesce(F.max(F.when(F.col("pair") == p, F.col("shown"))), empty).alias(name) for p, name in enumerate(columns)))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, ``text``, its ``hashes`` (of sentences), and ``next_text`` and ``next_hashes``: each row's successor by doc_id, nulls last, then text; the first follows the last.

    Rows lie in ranges of ids of about ``BUCKET_DOCS`` rows, at most ``MOST_BUCKETS`` of them. The ranges' first
    rows, which their predecessors need too, are sent to both; the list of their ids is that bounded.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n, least, most, cuts = base.agg(F.count("*"), F.min("doc_id"), F.max("doc_id"), F.percentile_approx("doc_id", [k / 256 for k in range(1, 256)], 2000)).first()
    buckets = min(MOST_BUCKETS, max(1, -(-n // BUCKET_DOCS)))
    if least is None:
        spot = F.lit(0)
    else:
        edges = sorted({least, *(cuts or [])} | {most + 1})
        fine = -(-buckets // max(1, len(edges) - 1))
        spans = F.lit(edges)
        coarse = F.size(F.filter(spans, lambda e: e <= F.col("doc_id")))
        lo, hi = F.get(spans, coarse - 1), F.get(spans, coarse)
        inner = F.least(F.lit(fine - 1), F.floor((F.col("doc_id") - lo).cast("double") / (hi - lo) * fine))
        spot = F.coalesce(coarse * fine + inner, F.lit(len(edges) * fine + fine)).cast("long")
    dealt = base.withColumn("bucket", spot)
    firsts = sorted((r["bucket"], r["f"]) for r in dealt.groupBy("bucket").agg(F.min("doc_id").alias("f")).collect())
    before = [(b, firsts[k - 1][0]) for k, (b, _) in enumerate(firsts)]
    heads = docs.sparkSession.createDataFrame([(f, p) for (b, f), (_, p) in zip(firsts, before, strict=True)], "first_id long, previous long")
    hashes = sentences(F.col("text")).alias("hashes")
    ghosts = base.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("first_id"))).select("doc_id", "text", hashes, F.col("previous").alias("bucket"), F.lit(1).alias("ghost"))
    every = dealt.select("doc_id", "text", hashes, "bucket", F.lit(0).alias("ghost")).union(ghosts)
    order = Window.partitionBy("bucket").orderBy("ghost", F.col("doc_id").asc_nulls_last(), "text")
    return every.withColumns({"next_text": F.lead("text").over(order), "next_hashes": F.lead("hashes").over(order)}).where("ghost = 0").drop("ghost", "bucket")


def edited(text: Column, following: Column) -> Column:
    """``text`` whose last half is replaced by the start of ``following``."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - half), F.substring(following, F.lit(1), half))


def compare(docs: DataFrame) -> DataFrame:
    """Each row's doc_id, ``n_chars``, the hash of its edited text, both texts' fingerprints, and its likeness to the edited and to the next text.

    ``docs`` needs doc_id and text; other columns are left out. A null text counts as empty and has no
    paragraph, so two of them are alike by 1 and one is unlike any other text. Equal texts have equal
    fingerprints; repeated rows are rows of their own, in order of their text. Texts of any length
    take one row of ``MOST`` paragraphs on average. An empty table gives no row.
    """
    rows = with_next(docs).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), F.col("hashes").alias("sa"), sentences(F.col("edited")).alias("sb"), F.col("next_hashes").alias("sc"))
    rows = durable(rows, "sentences").withColumns({f"l{x}": level(F.col(f"s{x}")) for x in "abc"})

    def cut(x: str, y: str) -> Column:
        """Digests of one text on the level of its comparison with another, if that is not its own."""
        return F.when(F.col(f"l{y}") > F.col(f"l{x}"), paragraphs(F.col(f"s{x}"), F.col(f"l{y}"))).alias(f"{x}_{y}")

    own = [paragraphs(F.col(f"s{x}"), F.col(f"l{x}")).alias(x) for x in "abc"]
    rows = durable(rows.select("row", "doc_id", "n_chars", "edited_sha256", *own, cut("a", "b"), cut("b", "a"), cut("a", "c"), cut("c", "a")), "digests")
    rows = _dealt(rows.withColumns({f"{x}_{y}": F.coalesce(f"{x}_{y}", x) for x, y in ("ab", "ba", "ac", "ca")}))
    near = likeness(rows, near_edited=("a_b", "b_a"), near_next=("a_c", "c_a"))
    shown = fingerprints(rows, fingerprint="a", edited_fingerprint="b")
    none = F.lit(f"{LEAST_THIRD}:")
    out = rows.select("row", "doc_id", "n_chars", "edited_sha256").join(near, "row").join(shown, "row", "left")
    return out.select("doc_id", "n_chars", "edited_sha256", F.coalesce("fingerprint", none).alias("fingerprint"), F.coalesce("edited_fingerprint", none).alias("edited_fingerprint"), "near_edited", "near_next")


def op6_iblt_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and how near they and the next document are."""
    return compare(spark.read.parquet(f"{sf_dir}/documents.parquet"))
