"""Benchmark decontamination by winnowing, in SQL functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.bloom import BLOCK_BITS, bit
from fleetlens.llm.common import ascii_lower, written

SPAN = 13  # words of a window
K = 8  # words whose hash may become a fingerprint
KEPT_OF = SPAN - K + 1  # hashes in a row of which the lowest is kept: any SPAN words have one

PRINT_PLACES = 512  # places of the bitmap for each fingerprint of the benchmark ...
MOST_PLACES = 1 << 23  # ... up to 1 MB, the most that is ever sent to every task
HITS = "array<struct<print:bigint,windows:array<struct<s:int,n:int,window:string>>>>"

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is mentioned."""
    return F.transform(F.array(value), use)[0]


def up_to(n: Column) -> Column:
    """1, 2, ... n; empty below 1."""
    return F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def words_of(text: Column) -> Column:
    """Lower-cased (A-Z) words; none of a null."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    lowered = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(ascii_lower(text))
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def _grams(words: Column, n: int) -> Column:
    """The hash of each ``n`` words in a row."""
    return let(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda h: F.transform(up_to(F.size(h) - n + 1), lambda i: F.xxhash64(F.slice(h, i, n))),
    )


def _winnowed(hashes: Column) -> Column:
    """The lowest of each ``KEPT_OF`` hashes in a row."""
    return F.array_distinct(
        F.transform(up_to(F.size(hashes) - KEPT_OF + 1), lambda i: F.array_min(F.slice(hashes, i, KEPT_OF)))
    )


def _hits(words: Column, hashes: Column, prints: Column, bits: Column, size: int, windows: Callable[[Column], Column]) -> Column:
    """Each place whose hash is one of ``prints`` and may be one of the benchmark's: the print, and windows there."""
    return let(
        F.filter(prints, lambda h: _may_hold(bits, h, size)),
        lambda some: F.when(
            F.size(some) > 0,
            F.transform(
                F.filter(up_to(F.size(hashes)), lambda i: F.array_contains(some, F.element_at(hashes, i))),
                lambda i: F.struct(F.element_at(hashes, i).alias("print"), windows(i).alias("windows")),
            ),
        ).otherwise(F.array().cast(HITS)),
    )


def _windows(words: Column, starts: Column, n: int) -> Column:
    return F.transform(
        starts,
        lambda s: F.struct(
            s.cast("int").alias("s"), F.lit(n).alias("n"), F.array_join(F.slice(words, s, n), " ").alias("window")
        ),
    )


def _around(words: Column, i: Column) -> Column:
    """The windows that hold the ``K`` words at ``i`` and lie within the text."""
    starts = F.filter(F.sequence(i - KEPT_OF + 1, i), lambda s: (s >= 1) & (s <= F.size(words) - SPAN + 1))
    return _windows(words, starts, SPAN)


def _from(words: Column, i: Column, lengths: list[int]) -> Column:
    """The windows of short items' lengths that begin at ``i``."""
    starts = lambda n: F.when(i + n - 1 <= F.size(words), F.array(i)).otherwise(F.array().cast("array<int>"))
    return F.concat(*[_windows(words, starts(n), n) for n in lengths])


def _places(print_: Column, size: int) -> list[Column]:
    return [F.pmod(print_, F.lit(size)), F.pmod(F.xxhash64(print_), F.lit(size))]


def _may_hold(bits: Column, print_: Column, size: int) -> Column:
    first, second = _places(print_, size)
    return bit(bits, first) & bit(bits, second)


def _filter(prints: DataFrame, size: int) -> DataFrame:
    """One row: a bitmap of ``size`` places, two of which each print sets."""
    slots = prints.select(F.explode(F.array(*_places(F.col("print"), size))).alias("slot"))
    set_ = slots.groupBy(F.expr(f"slot div {BLOCK_BITS}").alias("block")).agg(F.bitmap_construct_agg(F.col("slot") % BLOCK_BITS).alias("bits"))
    empty = F.unhex(F.lit("00" * (BLOCK_BITS // 8)))
    blocks = size // BLOCK_BITS
    every = prints.sparkSession.range(blocks).select(F.col("id").alias("block")).join(set_, "block", "left")
    listed = every.groupBy().agg(F.sort_array(F.collect_list(F.struct("block", F.coalesce("bits", empty).alias("bits")))).alias("all"))
    return listed.select(F.concat(*[F.col("all")[i]["bits"] for i in range(blocks)]).alias("bits"), F.lit(0).cast("long").alias("one"))


def _items(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return (
        items.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("words"))
        .where("size(words) > 0")
        .withColumn("n", F.least(F.size("words"), F.lit(SPAN)))
    )


def decontaminate(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """One row per document: ``(id_col, n_words, n_hit, n_items, items_sha256, contaminated)``.

    A window is ``SPAN`` words in a row of an item, or a shorter item as a whole. Words
    within an occurrence of a window are hit; ``n_items`` counts items with windows that
    occur, whose ids, sorted as strings and joined by commas, ``items_sha256`` digests. A
    document is contaminated if at least one word in twenty is hit.

    Both sides are winnowed: of any ``KEPT_OF`` hashes of ``K`` words in a row the lowest is
    a fingerprint, so every shared window shares one. A bitmap of the benchmark's
    fingerprints, of at most ``MOST_PLACES`` bits, goes to every task and rules out nearly all
    others where they are made; what is left is joined with the fingerprints. A hit is
    extended to the windows around it, which are compared as text. Texts are read once and
    never shuffled. Items shorter than a window are found by the hash of their first words.

    Null and empty texts have no words. Items with a null id hit as any others; together
    they are one of ``n_items``, and none of the ids in ``items_sha256``. Rows repeated
    with one id and text each get the same answer; different texts with one id are
    different documents. Other columns are not looked at.
    """
    bench = written(_items(items, item_col, item_text_col), "bench-items")
    lengths = sorted(r.n for r in bench.where(F.col("n") < SPAN).select("n").distinct().collect())  # below SPAN
    prints = [bench.where(F.col("n") == SPAN).select(F.explode(let(_grams(F.col("words"), K), _winnowed)).alias("print"))]
    least = lengths[0] if lengths else 0
    if lengths:
        begins = let(F.transform(F.slice("words", 1, least), lambda w: F.xxhash64(w)), lambda h: F.xxhash64(h))
        prints.append(bench.where(F.col("n") < SPAN).select(begins.alias("print")))
    marked = written(prints[0].union(prints[-1]).distinct() if lengths else prints[0].distinct(), "bench-prints")
    windows = written(
        bench.select(
            "item", F.explode(F.transform(up_to(F.size("words") - F.col("n") + 1), lambda i: F.array_join(F.slice("words", i, F.col("n")), " "))).alias("window")
        ),
        "bench-windows",
    )

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(
        F.col(id_col).alias("id"),
        F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.hex(F.xxhash64(text)), F.hex(F.hash(text))).alias("key"),
        text.alias("text"),
    )
    size = BLOCK_BITS
    while size < min(MOST_PLACES, PRINT_PLACES * marked.count()):
        size *= 2
    bitmap = written(_filter(marked, size), "bench-filter")

    def hits(words: Column, bits: Column) -> Column:
        found = let(_grams(words, K), lambda h: _hits(words, h, _winnowed(h), bits, size, lambda i: _around(words, i)))
        if not lengths:
            return found
        short = let(
            _grams(words, least),
            lambda h: _hits(words, h, F.array_distinct(h), bits, size, lambda i: _from(words, i, lengths)),
        )
        return F.concat(found, short)

    # The bitmap is taken out of its row once for each document, not for each fingerprint.
    facts = let(
        words_of(F.col("text")),
        lambda w: let(F.col("bits"), lambda b: F.struct(F.size(w).alias("n_words"), hits(w, b).alias("hits"))),
    )
    # The bitmap's one row, of at most MOST_PLACES / 8 bytes, for every document.
    met = keyed.withColumn("one", F.pmod(F.xxhash64("key"), F.lit(1))).join(F.broadcast(bitmap), "one")
    checked = written(met.select("id", "key", facts.alias("facts")).select("id", "key", "facts.*"), "checked")
    shared = (
        checked.where("size(hits) > 0")
        .select("key", F.explode("hits").alias("hit"))
        .select("key", "hit.*")
        .join(marked, "print", "left_semi")
    )
    found = shared.select("key", F.explode("windows").alias("w")).select("key", "w.*").join(windows, "window")
    per_doc = found.groupBy("key").agg(
        F.collect_set(F.struct("s", "n")).alias("spans"), F.sort_array(F.collect_set("item")).alias("items"),
        F.max(F.col("item").isNull().cast("int")).alias("unnamed"),
    )
    n_hit = F.size(
        F.array_distinct(F.flatten(F.transform("spans", lambda x: F.sequence(x["s"], x["s"] + x["n"] - 1))))
    )
    summed = per_doc.select(
        "key", n_hit.cast("long").alias("n_hit"), (F.size("items") + F.col("unnamed")).cast("long").alias("n_items"), F.array_join("items", ",").alias("items")
    )
    out = checked.drop("hits").join(summed, "key", "left").select(
        F.col("id").alias(id_col),
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"),
    )
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))
