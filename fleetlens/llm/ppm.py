"""LM scoring: prediction by partial matching over a byte-context trie learned from the corpus."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import record, slim, small_batches, written

ORDER = 4  # bytes of context
SYMBOLS = 257  # bytes and the end of a text
END = 256
GRAM_BITS = 8 * ORDER + 9
BEFORE = 0  # stands for what is before a text's first byte

# A context with a following byte is sent to every task if the corpus has it at least once
# in so many places, so that at most this many are; all others are joined.
KEPT = 1 << 22

# Words held by at least one in so many tokens are sent to every task; others are joined.
FREQUENT = 1 << 20


def _symbols(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes with an end after each, and the place where each text begins."""
    lengths = np.diff(starts)
    begins = starts[:-1] + np.arange(len(lengths))
    symbols = np.full(len(data) + len(lengths), END, np.int64)
    inside = np.ones(len(symbols), bool)
    inside[begins + lengths] = False
    symbols[inside] = data
    return symbols, np.append(begins, len(symbols))


def _grams(symbols: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """For each symbol: the ORDER bytes before it and itself, as one number.

    The nearest byte is the context's lowest, so the number of a shorter context is the
    number of the longer one without its highest bytes.
    """
    position = np.arange(len(symbols)) - np.repeat(begins[:-1], np.diff(begins))
    context = np.zeros(len(symbols), np.int64)
    for back in range(1, ORDER + 1):
        byte = np.zeros(len(symbols), np.int64)
        byte[back:] = symbols[:-back]
        byte[position < back] = BEFORE
        context |= byte << 8 * (back - 1)
    return context * 512 + symbols


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def corpus_counts(train: DataFrame) -> DataFrame:
    """``(gram, word, n)`` over all texts: byte contexts with what follows (word null), and words.

    The end of a text counts as a token: the word is then empty.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in small_batches(batches, 8 << 20):
            grams, counts = np.unique(_grams(*_symbols(texts.data, texts.starts)), return_counts=True)
            words: Counter[bytes] = Counter()
            for text in texts.each():
                words.update(words_of(text))
            words[b""] = len(texts)
            none = pa.nulls(len(grams), pa.binary())
            yield record(gram=grams, word=none, n=counts)
            yield record(
                gram=pa.nulls(len(words), pa.int64()),
                word=pa.array(list(words), pa.binary()),
                n=pa.array(list(words.values()), pa.int64()),
            )

    parts = train.mapInArrow(run, "gram long, word binary, n long")
    return parts.groupBy("gram", "word").agg(F.sum("n").alias("n"))


class Trie:
    """The contexts of each order with what follows them, in arrays of a hash table.

    A context's symbols are also seen after its shorter context, so what is excluded at a
    shorter context are just the symbols of the longer one. That makes the shares after
    exclusion a property of the context: ``rest[k]`` of an order-k context is the sum that
    its shorter context shares out once it has been escaped to.
    """

    def __init__(self, orders: list[tuple[np.ndarray, np.ndarray]]):
        """orders[k]: numbers ``context * 512 + symbol`` of order k, ascending, and their counts."""
        self.symbols = []
        self.contexts = []
        shorter = None
        for k, (grams, counts) in enumerate(orders):
            at = np.flatnonzero(np.diff(grams >> 9, prepend=-1))
            contexts = grams[at] >> 9
            total = np.add.reduceat(counts, at) if len(at) else np.zeros(0, np.int64)
            kinds = np.diff(np.append(at, len(grams)))
            own = np.log10(total + kinds)
            if k == 0:
                # Below the trie: every symbol not seen at all is as likely as any other.
                rest = np.full(len(at), math.log10(max(1, SYMBOLS - int(kinds.sum()))))
                fresh = np.maximum(SYMBOLS - kinds, 0)
            else:
                low_grams, low_counts, low_contexts, low_total, low_kinds = shorter
                parent = np.searchsorted(low_contexts, contexts & ((1 << 8 * (k - 1)) - 1))
                low_of = ((grams >> 9) & ((1 << 8 * (k - 1)) - 1)) * 512 + (grams & 511)
                taken = np.add.reduceat(low_counts[np.searchsorted(low_grams, low_of)], at) if len(at) else total
                fresh = low_kinds[parent] - kinds
                rest = np.log10(np.maximum(low_total[parent] - taken + fresh, 1))
            self.symbols.append(_Hash(grams, np.log10(counts)))
            self.contexts.append(
                _Hash(contexts, np.stack([own, np.log10(kinds), rest, np.where(fresh > 0, np.log10(np.maximum(fresh, 1)), np.nan)], 1))
            )
            shorter = grams, counts, contexts, total, kinds

    def log10_shares(self, grams: np.ndarray) -> np.ndarray:
        """log10 of the probability of each symbol after its context.

        The longest context that is in the trie is where a symbol starts. Where the context
        hasn't seen it, the escape is paid, and the shorter context shares out among what
        the longer one hasn't seen. An escape with nothing fresh to find there is free.
        """
        score = np.zeros(len(grams))
        todo = np.arange(len(grams))
        sum_, fresh = np.zeros(len(grams)), np.zeros(len(grams))
        inside = np.zeros(len(grams), bool)  # has met a context
        for k in range(len(self.symbols) - 1, -1, -1):
            mask = (1 << 8 * k) - 1
            own = ((grams[todo] >> 9) & mask) * 512 + (grams[todo] & 511)
            context = self.contexts[k].find(own >> 9)
            known = context >= 0
            facts = self.contexts[k].values[context]
            first = known & ~inside[todo]
            sum_[todo[first]] = facts[first, 0]
            fresh[todo[first]] = facts[first, 1]
            inside[todo[first]] = True
            symbol = np.full(len(todo), -1)
            symbol[known] = self.symbols[k].find(own[known])
            hit = symbol >= 0
            at = todo[hit]
            score[at] += self.symbols[k].values[symbol[hit]] - sum_[at]
            miss = known & ~hit
            at = todo[miss]
            free = np.isnan(fresh[at])  # nothing fresh here: go on at no cost
            score[at[~free]] += fresh[at[~free]] - sum_[at[~free]]
            sum_[at] = facts[miss, 2]
            fresh[at] = facts[miss, 3]
            todo = todo[~hit]
            if not len(todo):
                return score
        # Not in the trie at all.
        score[todo] -= np.where(inside[todo], sum_[todo], math.log10(SYMBOLS))
        return score


class _Hash:
    """Finds rows of ``values`` by key: open addressing in numpy arrays, half full at most."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys) * 2).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.rows = np.full(1 << self.bits, -1, np.int32)
        self.values = values.astype(np.float32) if len(values) else np.zeros((1, *values.shape[1:]), np.float32)
        left, place = np.arange(len(keys)), self._place(keys)
        while len(left):
            empty = self.keys[place] == -1
            self.keys[place[empty]] = keys[left[empty]]  # of several for one place the last gets it
            got = self.keys[place] == keys[left]
            self.rows[place[got]] = left[got]
            left, place = left[~got], (place[~got] + 1) & (1 << self.bits) - 1

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 where there is none."""
        place = self._place(keys)
        held = self.keys[place]
        rows = np.where(held == keys, self.rows[place], -1)
        left = np.flatnonzero((held != keys) & (held != -1))
        while len(left):
            place[left] = (place[left] + 1) & (1 << self.bits) - 1
            held = self.keys[place[left]]
            hit = held == keys[left]
            rows[left[hit]] = self.rows[place[left[hit]]]
            left = left[~hit & (held != -1)]
        return rows


def _of_order(k: int) -> Column:
    """The number of the order-k gram that ends the longest one."""
    context = F.shiftrightunsigned("gram", 9).bitwiseAND(F.lit((1 << 8 * k) - 1).cast("long"))
    return context * 512 + F.col("gram").bitwiseAND(F.lit(511).cast("long"))


def fit(longest: DataFrame) -> Trie:
    """The whole trie of a corpus of at most ``KEPT`` symbols, from its longest grams' counts.

    Each order's counts are sums of the next one's.
    """
    orders = []
    for k in range(ORDER + 1):
        own = longest.groupBy(_of_order(k).alias("gram")).agg(F.sum("n").alias("n")).toArrow()  # at most KEPT rows
        grams, n = own.column("gram").to_numpy(), own.column("n").to_numpy()
        order = np.argsort(grams)
        orders.append((grams[order].astype(np.int64), n[order].astype(np.int64)))
    return Trie(orders)


class Shares:
    """The shares of the frequent grams of the longest order; those of others are not known here."""

    def __init__(self, grams: np.ndarray, shares: np.ndarray):
        self.found = _Hash(grams, shares)

    def log10_shares(self, grams: np.ndarray) -> np.ndarray:
        """log10 of the probability of each symbol after its context, NaN where it has to be joined."""
        at = self.found.find(grams)
        return np.where(at >= 0, self.found.values[at], np.nan)


def _shares(longest: DataFrame) -> DataFrame:
    """``(gram, n, share)``: what each gram of the longest order that the corpus has scores."""
    context = Window.partitionBy(F.shiftrightunsigned("gram", 9))  # at most SYMBOLS rows
    return longest.select(
        "gram", "n", (F.log10("n") - F.log10(F.sum("n").over(context) + F.count("n").over(context))).alias("share")
    )


def _orders(longest: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """For each order all grams ``(gram, n)`` and all contexts with the facts that ``Trie`` has of them."""
    grams = [longest]
    for k in range(ORDER - 1, -1, -1):
        shorter = grams[0].groupBy(_of_order(k).alias("gram")).agg(F.sum("n").alias("n"))
        grams.insert(0, written(shorter, "ppm-grams"))
    orders = []
    lower = None
    for k, own in enumerate(grams):
        context = F.shiftrightunsigned("gram", 9).alias("context")
        if k == 0:
            held = own.groupBy(context).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
            held = held.withColumns({"fresh": SYMBOLS - F.col("kinds"), "rest": SYMBOLS - F.col("kinds")})
        else:
            # A gram or context has at most 256 that are longer by a byte, so no key is busy.
            taken = grams[k - 1].select(F.col("gram").alias("low"), F.col("n").alias("low_n"))
            held = (
                own.withColumn("low", _of_order(k - 1))
                .join(taken, "low")
                .groupBy(context)
                .agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"), F.sum("low_n").alias("taken"))
                .withColumn("parent", F.col("context").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1).cast("long")))
            )
            above = lower.select(
                F.col("context").alias("parent"), F.col("total").alias("low_total"), F.col("kinds").alias("low_kinds")
            )
            fresh = F.col("low_kinds") - F.col("kinds")
            held = held.join(above, "parent").withColumns({"fresh": fresh, "rest": F.col("low_total") - F.col("taken") + fresh})
        lower = written(held.select("context", "total", "kinds", "fresh", "rest"), "ppm-contexts")
        facts = lower.select(
            "context",
            F.log10(F.col("total") + F.col("kinds")).alias("own"),
            F.log10("kinds").alias("escape"),
            F.log10(F.greatest("rest", F.lit(1))).alias("rest"),
            F.when(F.col("fresh") > 0, F.log10("fresh")).alias("free_or"),
        )
        orders.append((own, facts))
    return orders


def _escaped(missing: DataFrame, longest: DataFrame) -> DataFrame:
    """``(gram, share)`` of grams that the corpus doesn't have: ``Trie.log10_shares`` by joins.

    ``sum`` is null until a context is met, ``fresh`` where an escape is free.
    """
    state = missing.select(
        "gram", F.lit(0.0).alias("share"), F.lit(None).cast("double").alias("sum"),
        F.lit(None).cast("double").alias("fresh"), F.lit(False).alias("done"),
    )
    for k, (own, facts) in reversed(list(enumerate(_orders(longest)))):
        small = F.broadcast if k <= 1 else lambda df: df  # at most 256 * SYMBOLS rows by nature
        asked = state.withColumns({"key": _of_order(k), "context": F.shiftrightunsigned(_of_order(k), 9)})
        met = asked.join(small(facts), "context", "left").join(
            small(own.select(F.col("gram").alias("key"), F.col("n").alias("c"))), "key", "left"
        )
        known = ~F.col("done") & F.col("own").isNotNull()
        met = met.withColumns(
            {
                "fresh": F.when(known & F.col("sum").isNull(), F.col("escape")).otherwise(F.col("fresh")),
                "sum": F.when(known & F.col("sum").isNull(), F.col("own")).otherwise(F.col("sum")),
            }
        )
        hit, miss = known & F.col("c").isNotNull(), known & F.col("c").isNull()
        state = met.select(
            "gram",
            F.when(hit, F.col("share") + F.log10("c") - F.col("sum"))
            .when(miss & F.col("fresh").isNotNull(), F.col("share") + F.col("fresh") - F.col("sum"))
            .otherwise(F.col("share"))
            .alias("share"),
            F.when(miss, F.col("rest")).otherwise(F.col("sum")).alias("sum"),
            F.when(miss, F.col("free_or")).otherwise(F.col("fresh")).alias("fresh"),
            (F.col("done") | hit).alias("done"),
        )
    last = F.col("share") - F.coalesce("sum", F.lit(math.log10(SYMBOLS)))
    return state.select("gram", F.when(F.col("done"), F.col("share")).otherwise(last).alias("share"))


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score)`` per document.

    The model is learned from all documents for which ``held_out`` (of ``id_col``) is
    false. ``score`` is the log10 probability of the text's bytes and its end under
    prediction by partial matching: up to ``ORDER`` bytes of context, escapes as likely as
    the number of kinds of symbols seen (method C), and exclusion of symbols already ruled
    out. ``base_score`` adds up log10((c+0.5)/(N+0.5(V+1))) over the lower-cased words and
    the text's end, by counts of whole tokens in the learned documents.

    Counts of all learned documents are added up in Spark. A word of the corpus may have
    any number of rows: only words that are at least one of ``FREQUENT`` tokens (so at
    most that many words) go to every task; what a document has of the others is joined.
    It is the same with the trie: the longest grams that are at least one of ``KEPT``
    symbols go to every task with their shares. A document's other grams are joined with
    the shares of all grams, and those that the corpus doesn't have with all contexts and
    grams of each order. No count is left out.

    A null or empty text is one token, its end. A null ``held_out`` counts as learned.
    Repeated rows count as often as they are there and are scored for each row. With
    nothing to learn from, every symbol is equally likely.
    """
    frame = slim(docs, id_col, text_col, held=F.coalesce(held_out, F.lit(False)))
    counts = written(corpus_counts(frame.where("not held").select("id", "text")), "ppm-counts")
    sums = counts.groupBy().agg(
        F.coalesce(F.sum(F.when(F.col("gram").isNotNull(), F.col("n"))), F.lit(0)).alias("symbols"),
        F.coalesce(F.sum(F.when(F.col("gram").isNull(), F.col("n"))), F.lit(0)).alias("tokens"),
        F.count(F.when(F.col("gram").isNull(), 1)).alias("kinds"),
    ).first()
    words = counts.where("gram is null").select("word", F.col("n").alias("c"))
    frequent = words.where(F.col("c") * FREQUENT >= sums.tokens).toArrow()  # at most FREQUENT rows
    context = docs.sparkSession.sparkContext
    longest = counts.where("gram is not null").select("gram", "n")
    whole = sums.symbols <= KEPT  # then every gram is frequent, and one that isn't there is known to be missing
    if whole:
        trie = context.broadcast(fit(longest))
    else:
        shares = written(_shares(longest), "ppm-shares")
        often = shares.where(F.col("n") * KEPT >= sums.symbols).select("gram", "share").toArrow()  # at most KEPT rows
        trie = context.broadcast(Shares(often.column("gram").to_numpy(), often.column("share").to_numpy()))
    known = context.broadcast(dict(zip(frequent.column("word").to_pylist(), frequent.column("c").to_pylist(), strict=True)))
    size = sums.tokens + 0.5 * (sums.kinds + 1)

    numbered = frame.withColumn("row", F.monotonically_increasing_id())
    scored = written(_first_pass(numbered, trie, known, size), "ppm-scored")
    # What is not frequent: (row, word, n), to be looked up among all words.
    rare = scored.select("row", F.explode("rare").alias("word", "n"))
    found = rare.join(words, "word", "left")
    term = F.log10((F.coalesce("c", F.lit(0)) + 0.5) / F.lit(size)) * F.col("n")
    n_found = F.when(F.col("c") > 0, F.col("n"))
    terms = found.select("row", term.alias("more"), n_found.alias("n_found"), F.lit(None).cast("double").alias("grams"))
    if not whole:
        # Learned texts have no gram that the corpus doesn't have.
        asked = scored.where("held").select(F.explode("rare_grams").alias("gram", "n")).select("gram").distinct()
        seldom = shares.where(F.col("n") * KEPT < sums.symbols).select("gram", "share")
        missing = written(asked.join(seldom, "gram", "left_anti"), "ppm-missing")
        every = seldom.unionByName(written(_escaped(missing, longest), "ppm-escaped"))
        met = scored.select("row", F.explode("rare_grams").alias("gram", "n")).join(every, "gram")
        none = F.lit(None)
        terms = terms.unionByName(
            met.select("row", none.cast("double").alias("more"), none.cast("long").alias("n_found"), (F.col("share") * F.col("n")).alias("grams"))
        )
    rest = terms.groupBy("row").agg(*[F.sum(c).alias(c) for c in ("more", "n_found", "grams")])
    return scored.join(rest, "row", "left").select(
        F.col("id").alias(id_col),
        F.col("held").alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("n_found", F.lit(0))).alias("n_known"),
        F.lit(sums.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("grams", F.lit(0.0))).alias("score"),
    )


def _first_pass(numbered: DataFrame, trie: Broadcast, known: Broadcast, size: float) -> DataFrame:
    """Score each text with the frequent grams and words; list its other grams and words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, logs = trie.value, {w: math.log10((c + 0.5) / size) for w, c in known.value.items()}
        for texts in small_batches(batches):
            symbols, begins = _symbols(texts.data, texts.starts)
            grams = _grams(symbols, begins)
            shares = model.log10_shares(grams)
            open_ = np.flatnonzero(np.isnan(shares))
            shares[open_] = 0
            upto = np.concatenate([[0.0], np.cumsum(shares)])
            # A gram takes GRAM_BITS, the text's number within the batch the bits above.
            held_by = np.searchsorted(begins, open_, "right") - 1
            keys, times = np.unique(held_by << GRAM_BITS | grams[open_], return_counts=True)
            gram_cuts = np.searchsorted(keys >> GRAM_BITS, np.arange(len(texts) + 1))
            tokens, found, base, rare_words, rare_counts, cuts = [], [], [], [], [], [0]
            for text in texts.each():
                words = words_of(text)
                words.append(b"")
                hits = [logs[w] for w in words if w in logs]
                tokens.append(len(words))
                found.append(len(hits))
                base.append(math.fsum(hits))
                if len(hits) < len(words):
                    others = Counter(w for w in words if w not in logs)
                    rare_words.extend(others)
                    rare_counts.extend(others.values())
                cuts.append(len(rare_words))
            entries = pa.MapArray.from_arrays(
                pa.array(cuts, pa.int32()), pa.array(rare_words, pa.binary()), pa.array(rare_counts, pa.int64())
            )
            yield record(
                id=texts.ids,
                held=texts.rows.column("held"),
                row=texts.rows.column("row"),
                n_tokens=pa.array(tokens, pa.int64()),
                n_known=pa.array(found, pa.int64()),
                base=pa.array(base, pa.float64()),
                score=np.subtract(upto[begins[1:]], upto[begins[:-1]]),
                rare=entries,
                rare_grams=pa.MapArray.from_arrays(
                    pa.array(gram_cuts, pa.int32()), pa.array(keys & (1 << GRAM_BITS) - 1), pa.array(times, pa.int64())
                ),
            )

    kind = numbered.schema["id"].dataType.simpleString()
    return numbered.mapInArrow(
        run,
        f"id {kind}, held boolean, row long, n_tokens long, n_known long, base double, score double, "
        "rare map<binary,long>, rare_grams map<long,long>",
    )
