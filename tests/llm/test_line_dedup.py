"""Line dedup: planted passages go from later documents, everything else stays."""

import random

import numpy as np
import pyarrow as pa
import pytest

from fleetlens.llm import line_dedup as module
from fleetlens.llm.common import small_batches
from fleetlens.llm.line_dedup import LEAST_BLOCK, WORD, Pieces, aligned, extended, line_dedup, repeated_ranges, without_repeats


def prose(draw, n):
    return " ".join("".join(draw.choices("abcdefghijklmnop", k=draw.randint(2, 9))) for _ in range(n))


def chinese(draw, n):
    return "".join(chr(draw.randrange(0x4E00, 0x9000)) for _ in range(n))


def batch(texts):
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["id", "text"])
    return next(small_batches([rows]))


def dedup(spark, texts, parts=3):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in line_dedup(docs.repartition(parts)).collect()}


def test_pieces_cover_texts_and_do_not_depend_on_place():
    draw = random.Random(4)
    shared = prose(draw, 80)
    texts = ["", None, " \n ", f"{prose(draw, 30)} {shared} {prose(draw, 5)}", f"\n{prose(draw, 3)} {shared}\nend é", "a\nb\nb\nb", chinese(draw, 70)]
    some = batch(texts)
    p = Pieces(some)
    for i, text in enumerate(texts):
        mine = np.flatnonzero(p.doc == i).tolist()
        assert sum(p.weight[mine]) == (70 if i == 6 else WORD * len((text or "").split()))
        assert all(p.end[j] == p.begin[j + 1] for j in mine[:-1])
        assert not mine or p.end[mine[-1]] == some.starts[i + 1]
    keys = [set(p.keys[p.doc == i].tolist()) for i in range(len(texts))]
    assert len(keys[3] & keys[4]) >= 3
    assert len(keys[5]) == 2 and (p.doc == 5).sum() == 4


@pytest.mark.parametrize("words", [33, 51, 80])
def test_every_passage_of_two_windows_has_a_whole_piece(words):
    draw = random.Random(words)
    for _ in range(150):
        passage = prose(draw, words)
        p = Pieces(batch([f"{prose(draw, draw.randrange(40))} {passage} {prose(draw, draw.randrange(40))}" for _ in range(2)]))
        common = set(p.keys[p.doc == 0].tolist()) & set(p.keys[p.doc == 1].tolist())
        shared = sum(int(w) for k, w, d in zip(p.keys.tolist(), p.weight, p.doc, strict=True) if d == 0 and k in common)
        assert shared >= WORD and (words < 51 or shared >= LEAST_BLOCK)


def test_slices_of_long_texts_have_the_same_pieces(monkeypatch):
    draw = random.Random(8)
    text = "\n".join(prose(draw, draw.randrange(12)) for _ in range(200)) + "\n"
    whole = Pieces(batch([text]))
    got = list(module._cut(batch([text]), 700))
    assert len(got) > 5
    assert np.concatenate([p.keys for _, p in got]).tolist() == whole.keys.tolist()
    assert np.concatenate([p.end + s[p.doc] for s, p in got])[-1] == len(text)
    places = [(b + s[0], e + s[0]) for s, p in got for b, e in zip(p.begin.tolist(), p.end.tolist(), strict=True)]
    assert all(a[1] == b[0] for a, b in zip(places, places[1:], strict=False))
    for odd in (" " * 3000, "x" * 3000, "漢" * 1000, "\n" * 3000):
        assert b"".join(part.tobytes() for _, part in module._slices(np.frombuffer(odd.encode(), np.uint8), 700)).decode() == odd


def test_aligned_is_a_longest_rising_run():
    assert aligned([(0, 5), (1, 1), (2, 2), (3, 9), (4, 3)]) == [1, 2, 4]
    assert aligned([]) == []


def test_short_or_scattered_repeats_stay():
    def gone(*blocks):
        return [(a[0], z[1]) for a, z in repeated_ranges([(b, e, s, at, at + e - b, w * WORD) for b, e, s, at, w in blocks])]

    assert gone((3, 9, "a", 7, 11)) == []
    assert gone((3, 9, "a", 7, 13)) == [(3, 9)]
    assert gone((3, 9, "a", 7, 10), (9, 12, "b", 1, 2)) == [(3, 12)]
    assert gone(*[(i, i + 1, c, 0, 4) for i, c in enumerate("abcd")]) == []
    assert gone((0, 9, "a", 50, 12), (9, 20, "a", 0, 12), (30, 40, "a", 60, 12)) == [(0, 20), (30, 40)]


def test_extension():
    text = b"one two three FOUND four five"
    a, b = text.index(b"FOUND"), text.index(b"four")
    assert extended(text, a, b, b"x two three ", b"four six") == (text.index(b"two"), text.index(b"five"))
    assert extended(text, a, b, b"xthree ", b"fourth") == (a, b)
    assert extended(text, a, b, None, b"") == (a, b)
    assert extended(text, a, b, b"one two three ", b"four five") == (0, len(text))
    run = ("甲" * 30 + "乙丙丁").encode()
    text = run + b"FOUND" + run
    a, b = len(run), len(run) + 5
    got = extended(text, a, b, ("戊" * 30 + "丙丁").encode(), ("甲" * 3 + "己" * 30).encode())
    assert text[got[0] : a].decode() == "丙丁" and text[b : got[1]].decode() == "甲" * 3


def test_planted_passages(spark):
    draw = random.Random(1)
    passage, line = prose(draw, 60), prose(draw, 15)
    texts = {i: f"{prose(draw, 40)}.\n{prose(draw, 25)}" for i in range(40)}
    clean = dict(texts)
    around = {}
    for i in (5, 9, 21):
        around[i] = prose(draw, 20), prose(draw, 20)
        texts[i] = f"{around[i][0]} {passage} {around[i][1]}"
    for i in (7, 8, 30):
        texts[i] += f"\n{line}"
    texts[35] = texts[3]
    texts[36], texts[37] = None, ""
    rows = [(i, t, "w") for i, t in texts.items()] + [(None, texts[3], "w"), (2, texts[2], "w")]
    got = line_dedup(spark.createDataFrame(rows, "doc_id long, text string, words string").repartition(3)).collect()
    assert len(got) == len(rows)
    left = {r.doc_id: r for r in got}
    assert passage in left[5].text and line in left[7].text
    for i in (9, 21):
        assert left[i].text.split() == " ".join(around[i]).split() and left[i].n_removed == 60
    for i in (8, 30):
        assert left[i].text.strip() == clean[i]
    assert left[35].text == "" and left[3].text == texts[3]
    assert left[36].text is None and left[37].text == "" and left[None].text == texts[3]
    for i in set(range(35)) - {5, 7, 8, 9, 21, 30}:
        assert (left[i].text, left[i].n_removed, left[i].n_blocks) == (clean[i], 0, 0)
    assert all(r.n_words == len((texts.get(r.doc_id, texts[3]) or "").split()) for r in got)


def test_differing_texts_of_one_id(spark):
    draw = random.Random(3)
    passage = prose(draw, 60)
    texts = [(1, f"a b {passage} c d"), (2, f"e f {passage} g h"), (2, "three short words"), (2, prose(draw, 60)), (2, None), (2, f"e f {passage} g h")]
    for seed in range(3):
        random.Random(seed).shuffle(texts)
        docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(2)
        got = sorted((r.doc_id, r.text or "") for r in line_dedup(docs).collect())
        want = sorted((i, "e f g h" if i == 2 and passage in (t or "") else t or "") for i, t in texts)
        assert got == want


@pytest.mark.parametrize("words", [51, 60, 150])
def test_recall_of_passages_in_longer_lines(spark, words):
    """Against the truth: nearly all words of each repeated passage go, and nothing else."""
    draw = random.Random(words)
    passages = [prose(draw, words) for _ in range(120)]
    own = [[(prose(draw, draw.randint(3, 40)), prose(draw, draw.randint(3, 40))) for _ in passages] for _ in range(2)]
    texts = [f"{a} {p} {b}" for docs in own for (a, b), p in zip(docs, passages, strict=True)]
    left = dedup(spark, texts)
    removed, kept = 0, 0
    for i, (a, b) in enumerate(own[1], len(passages)):
        assert len(left[i].text.split()) >= len(f"{a} {b}".split()) - 1  # a word beside it may be the same by chance
        removed += left[i].n_removed
        kept += left[i].text.split() == f"{a} {b}".split()
        assert left[i - len(passages)].n_removed == 0
    assert removed >= 0.98 * words * len(passages) and kept >= 0.95 * len(passages)


def test_text_without_blanks(spark):
    draw = random.Random(11)
    line, other = chinese(draw, 600), chinese(draw, 600)
    texts = [f"{chinese(draw, 90)}{line}{chinese(draw, 50)}", f"{chinese(draw, 40)}{line}{chinese(draw, 80)}", other, f"{line}\n{other}", chinese(draw, 30) * 2]
    left = dedup(spark, texts)
    assert left[0].text == texts[0] and left[2].text == other and left[3].text.strip() == "" and left[4].text == texts[4]
    assert left[1].text == texts[1][:40] + texts[1][640:]


@pytest.mark.parametrize("size", [0, 1])
def test_small_tables(spark, size):
    docs = spark.createDataFrame([(1, "x " * 500)][:size], "doc_id long, text string")
    assert line_dedup(docs).count() == size


def test_keys_of_many_words_differ():
    p = Pieces(batch([" ".join(map(str, range(20000)))]))
    assert len(np.unique(p.keys)) == len(p.keys)


def test_passages_in_other_order_and_further_copies_go(spark):
    draw = random.Random(6)
    a, b, c = (prose(draw, 90) for _ in range(3))
    own = [prose(draw, 30) for _ in range(6)]
    texts = [f"{a}\n{own[0]}\n{b}", f"{own[1]}\n{b}\n{own[2]}\n{a}", c, f"{c}\n{own[3]}\n{c}\n{own[4]}\n{c}", f"{own[5]}\n{a}\n{a}"]
    left = {i: r.text for i, r in dedup(spark, texts).items()}
    assert left[0] == texts[0] and left[2] == c
    assert left[1].split() == f"{own[1]} {own[2]}".split()
    assert left[3].split() == f"{own[3]} {own[4]}".split()
    assert left[4].split() == own[5].split()


def test_frequent_lines(spark):
    """A line in most documents: its first place goes to every task, and the result is the same."""
    draw = random.Random(9)
    line, own = prose(draw, 20), [prose(draw, 30) for _ in range(400)]
    left = dedup(spark, [f"{x}\n{line}" if i % 4 else x for i, x in enumerate(own)], 5)
    for i, x in enumerate(own):
        assert left[i].text.strip() == (f"{x}\n{line}" if i == 1 else x)


def test_columns_of_any_name_and_text_ids(spark):
    draw = random.Random(2)
    line = prose(draw, 40)
    rows = [(f"k{i}", i, f"{prose(draw, 5)}\n{line}" if i < 4 else line if i == 4 else " ", "r", b"x", 1.5) for i in range(6)]
    docs = spark.createDataFrame(rows, "key string, gone long, body string, row string, _maybe binary, id double")
    got = {r.key: r for r in without_repeats(docs, "key", "body").collect()}
    assert without_repeats(docs, "key", "body").schema == docs.schema
    assert set(got) == {"k0", "k1", "k2", "k3", "k5"}  # k4 has nothing left
    assert got["k0"].body == rows[0][2] and got["k2"].body.split() == rows[2][2].split()[:5] and got["k5"].body == " "
    assert all(tuple(got[r[0]])[i] == r[i] for r in rows if r[0] in got for i in (0, 1, 3, 4, 5))
