"""Problems 3, 7 and 9 against brute force, and their edge cases."""

import random
import re
import time

import numpy as np
import pytest

from gleanery.llm import leaks, mixing, neardup, truncation

WORD = re.compile(r"[^\W_]+")


def _words(t):
    return [w.lower() for w in WORD.findall(t or "")]


def _corpus(n=300, seed=4):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(900)]
    out = []
    for i in range(n):
        text = [rng.choice(vocabulary) for _ in range(rng.randint(20, 90))]
        out.append(" ".join(text))
        for _ in range(i % 3):
            t = list(text)
            for _ in range(rng.randint(0, 5)):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            cut = rng.randrange(len(t))
            out.append((" " if i % 2 else " - ").join(t[cut:] + t[:cut]).upper())
    return out


def _pairs(rows, width, limit):
    sets = {}
    for i, t in rows:
        w = _words(t)
        s = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)}
        if s:
            sets.setdefault(i, s)
    ids = sorted(sets)
    return {
        (a, b) for x, a in enumerate(ids) for b in ids[x + 1 :]
        if len(sets[a] & sets[b]) >= limit * len(sets[a] | sets[b]) - 1e-9
    }


@pytest.mark.parametrize("width,limit", [(3, 0.7), (5, 0.8)])
def test_near_duplicates(spark, width, limit):
    texts = _corpus()
    rows = list(enumerate(texts)) + [(9000 + i, texts[0]) for i in range(6)]
    rows += [(9100, None), (9101, ""), (9102, "two words"), (9103, "x " * 40_000), (9104, "x " * 40_000 + "y z")]
    df = spark.createDataFrame([(i, t, "a", 1, "b") for i, t in rows + rows[:4]] + [(None, texts[1], "", 1, "")],
                               "id long, text string, words string, rep int, regs string")
    members, pairs = neardup.near_duplicates(df, "id", "text", width, limit)
    got = {(r["a"], r["b"]) for r in neardup.duplicate_pairs(members, pairs).collect()}
    want = _pairs(rows, width, limit)
    assert got <= want and len(want - got) <= 0.01 * len(want) and len(want) > 50
    ids = {r["id"] for r in members.collect()}
    assert not ids & {9100, 9101, 9102} and 9103 in ids and None not in ids


def test_near_duplicates_of_nothing(spark):
    df = spark.createDataFrame([], "id long, text string")
    members, pairs = neardup.near_duplicates(df, "id", "text")
    assert members.count() == 0 and pairs.count() == 0


def test_registers_estimate_similarity():
    rng = np.random.default_rng(0)
    for j in (0.3, 0.7, 0.9):
        n, off = 3000, []
        for _ in range(20):
            common = rng.integers(0, 2**63, int(n * j), dtype=np.uint64)
            a = np.unique(np.r_[common, rng.integers(0, 2**63, (n - len(common)) // 2, dtype=np.uint64)])
            b = np.unique(np.r_[common, rng.integers(0, 2**63, (n - len(common)) // 2, dtype=np.uint64)])
            _, x = neardup.sketch(np.zeros(len(a), np.int64), a)
            _, y = neardup.sketch(np.zeros(len(b), np.int64), b)
            more, less = (x > y).sum(axis=1), (x < y).sum(axis=1)
            off.append(neardup.joint_similarity(more, less, np.array([float(len(a))]), np.array([float(len(b))]))[0] - j)
        assert abs(np.mean(off)) < 0.03 and np.std(off) < 0.08


def test_sketches_of_unions_are_maxima():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2**63, 500, dtype=np.uint64), rng.integers(0, 2**63, 700, dtype=np.uint64)
    one = lambda h: neardup.sketch(np.zeros(len(h), np.int64), np.unique(h))[1]
    assert (np.maximum(one(a), one(b)) == one(np.r_[a, b])).all()


def test_banding_reaches_its_recall():
    for limit in (0.5, 0.7, 0.8, 0.95):
        width, bands = neardup.banding(limit)
        assert width * bands <= neardup.REGISTERS and 1 - (1 - limit**width) ** bands >= 0.9995 or limit == 0.5


# ------------------------------------------------------------------------------------------------ leaks


def _plain_tiles(doc, item, least):
    """Greedy tiling by brute force."""
    used_d, used_i, out = [False] * len(doc), [False] * len(item), []
    while True:
        best = None
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n] and not used_i[i + n] and not used_d[d + n]:
                    n += 1
                if n >= least and (best is None or n > best[2]):
                    best = (i, d, n)
        if best is None:
            return out
        for k in range(best[2]):
            used_i[best[0] + k] = used_d[best[1] + k] = True
        out.append(best)


def test_tiles_match_brute_force():
    rng = random.Random(2)
    for _ in range(60):
        item = [rng.randrange(30) for _ in range(rng.randint(0, 40))]
        doc = [rng.randrange(30) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 4)):
            n = rng.randint(2, 15)
            at, to = rng.randrange(len(item) + 1), rng.randrange(len(doc) + 1)
            doc[to:to] = item[at : at + n]
        got = leaks.tiles(np.array(doc, np.int64), np.array(item, np.int64), 3)
        want = _plain_tiles(doc, item, 3)
        assert [n for *_, n in got] == [n for *_, n in want]
        assert all(item[i : i + n] == doc[d : d + n] for i, d, n in got)


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_leaks(spark, broadcast):
    rng = random.Random(6)
    vocabulary = [f"v{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(9, 60)))) for i in range(30)]
    docs = []
    for d in range(200):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 120))]
        if d % 3 == 0:
            source = items[d % 30][1].split()
            n = rng.randint(5, len(source))
            at = rng.randrange(len(source) - n + 1)
            words[len(words) // 2 : len(words) // 2] = source[at : at + n]
        docs.append((d, (", " if d % 2 else "\n").join(words).title()))
    docs += [(1000, None), (1001, ""), (1002, items[3][1] + " a" * 50_000), docs[0]]
    extra = [(None, "x"), (50, None), (51, ""), items[0]]
    found = leaks.leaks(
        spark.createDataFrame([(*r, "x", 1) for r in docs], "doc long, text string, item string, seed int"), "doc", "text",
        spark.createDataFrame([(*r, "x") for r in items + extra], "item long, text string, words string"), "item", "text",
        broadcast_seeds=broadcast,
    )
    rows = found.collect()
    want = set()
    for d, t in docs:
        dw = _words(t)
        runs = {tuple(dw[k : k + 10]) for k in range(len(dw) - 9)}
        want |= {(d, i) for i, s in items if runs & {tuple(_words(s)[k : k + 10]) for k in range(len(_words(s)) - 9)}}
    assert {(r["doc"], r["item"]) for r in rows} == want and len(rows) == len(want) > 20
    assert all(10 <= r["longest"] <= r["covered"] <= r["item_words"] for r in rows)


def test_leaks_of_nothing(spark):
    none = spark.createDataFrame([], "id long, text string")
    some = spark.createDataFrame([(1, "a b c d e f g h i j k l")], "id long, text string")
    assert leaks.leaks(none, "id", "text", some, "id", "text").count() == 0
    assert leaks.leaks(some, "id", "text", none, "id", "text").count() == 0
    assert leaks.leaks(some, "id", "text", some, "id", "text").collect()[0]["covered"] == 12


def _crowd(n, seed=11, spread=12):
    """Texts near one text: some within half the limit of it, some further off, and a second crowd."""
    rng = random.Random(seed)
    base = [[f"c{k}w{i}" for i in range(160)] for k in range(2)]
    base[1][:100] = base[0][:100]
    out = []
    for i in range(n):
        t = list(base[i % 7 == 0])
        for _ in range(rng.randint(0, 2) if i % 5 else rng.randint(0, spread)):
            t[rng.randrange(len(t))] = f"e{rng.randrange(10**6)}"
        out.append((i, " ".join(t)))
    return out


@pytest.mark.parametrize("hot", [10, 1000])
def test_crowds_are_balls_around_pivots(spark, hot):
    rows = _crowd(160) + [(1000 + i, t) for i, t in enumerate(_corpus(60))]
    df = spark.createDataFrame(rows, "d long, t string")
    sets = {i: {tuple(_words(t)[k : k + 5]) for k in range(len(_words(t)) - 4)} for i, t in rows}
    first = {}
    rep = {i: first.setdefault(frozenset(s), i) for i, s in sorted(sets.items()) if s}
    reps = sorted(set(rep.values()))
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for k, a in enumerate(reps) for b in reps[k + 1 :]}
    want = {k: v for k, v in want.items() if v >= 0.8 - 1e-12}
    _, pairs = neardup.near_duplicates(df, "d", "t", recall=1.0, hot=hot)
    got = pairs.collect()
    assert len(got) == len(want) > 2000 and {(r["a"], r["b"]): pytest.approx(r["similarity"]) for r in got} == want
    found = neardup.near_duplicate_links(df, "d", "t", recall=1.0, hot=hot)
    assert (found[2].count() > 40) == (hot == 10)
    groups = neardup.duplicate_groups(*found[:3]).collect()
    links, near = {}, {}
    for a, b in want:
        for x, y in ((a, b), (b, a)):
            links[x] = links.get(x, 0) + 1
            near.setdefault(x, set()).add(y)
    copies = {r: list(rep.values()).count(r) for r in reps}
    assert {r["id"]: r["links"] for r in groups} == {i: links.get(r, 0) for i, r in rep.items() if links.get(r) or copies[r] > 1}
    by = {}
    for r in groups:
        by.setdefault(r["group_id"], set()).add(r["rep"])
    assert all(g == min(v) for g, v in by.items()) and all(y in by[r["group_id"]] for r in groups for y in near.get(r["rep"], ()))


# ------------------------------------------------------------------------------------------------ truncation

WHOLE = [
    "The frame is sharp.", "Is it? ", 'She said "stop."', "Fertig!\n", "It works. 🙂", "Done. (sic)", "Done. [end]", "Fin. »ok«",
    "It was good. #sun #sea", "We left.\n\nBest,\nAnna", "We left.\n\nGrüße\nJürgen", "We left.\n\n— Mia", "Seen.\n- map sheet\n- price list",
    "Seen.\nTags: hazy, warm", "Seen.\nTotal: 476", "Seen.\nIMG_5181.png", "Run:\n```\nscore = 5\n```", '{"score": 3, "text": "a (b"}',
    "Later. To be continued…", "More. And so on...", "More. Etc. ...", "", "  \n", "Ende. ***", "<p>Text.</p>", "See a) and b).",
]
CUT = [
    "The frame is sha", "The frame is sharp and", "The frame is sharp, ", "The poster draft wi-", "The frame […]", "The fr…", "The ...",
    "The frame [...]", "Das Bild ist markier�", "ends with VID_3080.", '{"score": 3, "text": "The frame is sharp.', '{"score": 3, "text": "a\\',
    '{"score": 3', "Run:\n```\nscore = 5", "Good. <a hre", "The price of the\nIMG_5181.png", "We left.\n\nThe", "We left.\n\nBest,", "Seen.\nTags: hazy,",
    "He paid 17 of the 20",
]


def test_ends():
    assert [t for t in WHOLE if truncation.judge_end(t)[0] != "whole"] == []
    assert [t for t in CUT if truncation.judge_end(t)[0] == "whole"] == []


def test_ends_of_very_long_texts():
    for body in ("a. " * 300_000, "#tag " * 200_000, "." * 300_000 + " x. ", "(" * 200_000 + ". ", "- a\n" * 100_000):
        assert truncation.judge_end(body + "Then it ended.")[0] == "whole"
        assert truncation.judge_end(body + "\n\nThen it was cut in the mid")[0] == "soft"
    assert truncation.judge_end("It was good." + " #sun" * 50_000)[0] == "whole"


def test_stack_automaton():
    assert truncation.open_structures("a (b [c] d") == ["("]
    assert truncation.open_structures("```\n(\n```") == []
    assert truncation.open_structures('{"a": "b\\"c') == ["{", '"']
    assert truncation.open_structures('{"a": "}"}') == []
    assert truncation.open_structures("1) one 2) two") == []
    assert truncation.open_structures('She said "we') == ['"'] and truncation.open_structures('She said "we go," and left') == []
    assert truncation.open_structures('a 5" pipe and 6\' 2" tall') == [] and truncation.open_structures("(she said (\"no") == ["(", "(", '"']
    assert truncation.open_structures("Er sagte „ja") == ["„"] and truncation.open_structures("Er sagte „ja“ und “yes” «oui» »ja«") == []
    assert truncation.open_structures("<p>text <b>bold") == ["<p>", "<b>"] and truncation.open_structures("<p>a<br>b<img src='x'/></p>") == []
    assert truncation.open_structures("<ul><li>a<li>b</ul> x < y") == [] and truncation.open_structures("<p>x</b>") == ["<p>"]


def test_the_automaton_is_linear():
    began = time.perf_counter()
    for n in (200_000,):
        assert truncation.open_structures("(" * n + ")" * n) == [] and len(truncation.open_structures("[" * n + ")" * n)) == n
        assert len(truncation.open_structures("(" + "[" * n + "}" * n)) == n + 1
    assert time.perf_counter() - began < 20


def test_open_structures_count_against_their_source(spark):
    """A source that rarely ends in a terminator: what is open decides, unless whole texts leave it open as well."""
    rows = [(i, f"no end {i}", "captions") for i in range(20)] + [(30, "the (left", "captions"), (31, 'he said "go', "captions"), (32, "<p>a <b>c", "captions"), (33, "All in.", "captions")]
    rows += [(100 + i, f"smile :( {i}.", "chat") for i in range(10)] + [(200 + i, f"sad :( {i}", "chat") for i in range(12)]
    got = {r["id"]: (r["end"], r["cut"]) for r in truncation.truncated(spark.createDataFrame(rows, "d long, t string, s string"), "d", "t", "s").collect()}
    assert {i for i, (_, cut) in got.items() if cut} == {30, 31, 32} and got[30][0] == got[32][0] == "open" and got[200] == ("soft", False)


def test_bytes_that_are_no_text(spark):
    raw = [(1, b"Das Bild ist h\xc3"), (2, b"Price 5 \xe2\x82"), (3, b"bad \xff byte, whole sentence."), (4, b"\xff then \xf0\x9f\x98"), (5, "Schön.".encode()), (6, b"caf\xe9.")]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in raw], "d long, b binary").selectExpr("d", "cast(b as string) t", "'s' s")
    got = {r["id"]: (r["end"], r["cut"]) for r in truncation.truncated(df, "d", "t", "s").collect()}
    assert {i for i, (_, cut) in got.items() if cut} == {1, 2, 4} and got[1][0] == got[2][0] == got[4][0] == "broken"
    assert all(r["tokens"] > 0 for r in mixing.count_tokens(df, "t").collect())


def test_truncated(spark):
    rows = [(i, t, "Mail-Archive") for i, t in enumerate(WHOLE)] + [(100 + i, t, " mail_archive") for i, t in enumerate(CUT)]
    rows += [(200 + i, f"no dot {i}", "LABELS") for i in range(10)] + [(300, "cut …", "labels"), (301, None, "labels"), (302, "x", None), (303, "x. " * 100_000, None)]
    df = spark.createDataFrame([(*r, True, "x") for r in rows + rows[:2]], "doc long, text string, source string, cut boolean, id string")
    got = truncation.truncated(df, "doc", "text", "source").collect()
    assert len(got) == len({r["id"] for r in got})
    cut = {r["id"] for r in got if r["cut"]}
    assert cut == {100 + i for i in range(len(CUT))} | {300}
    assert {r["source"] for r in got} == {"mail_archive", "labels", None}
    assert 301 not in {r["id"] for r in got}
    assert truncation.truncated(df.limit(0), "doc", "text", "source").count() == 0
