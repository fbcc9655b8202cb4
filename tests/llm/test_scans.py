import random
import re
import time

import pytest

from lodestone.llm import decontamination, fingerprints, licenses
from lodestone.llm.common import plain_words

MIT = licenses.TEMPLATES["mit-text"][1]


def scan(spark, texts):
    df = spark.createDataFrame([(i, t, "n", 1.5) for i, t in enumerate(texts)], "doc_id long, text string, labels string, score double")
    return {r["doc_id"]: r for r in licenses.scan_licenses(df).collect()}


def test_phrases_against_plain(spark):
    texts = ["MIT License and the Apache license; GNU General Public License. mit license", "mit-license", "licence mit", "", None, "general public  LICENSE x license", "élicense mit license"]
    rows = scan(spark, texts)
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        places = sorted((k, label) for p, label in licenses.PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split())
        r = rows[i]
        assert (r["n_words"], r["n_base"]) == (len(words), len(places))
        assert (r["first_word"], r["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
        assert 0 <= r["score"] <= 1


def test_spans(spark):
    edited = MIT.replace("free of charge", "gratis").replace("without restriction", "without any restriction whatsoever")
    texts = ["some code " + MIT + " more", "before " + edited, "permission is hereby granted to nobody", "x. Licensed under CC BY-NC 4.0.", "the software is the best software of the house"]
    rows = scan(spark, texts)
    n = len(plain_words(MIT.encode()))
    s = rows[0]["spans"][0]
    assert (s["label"], s["first_word"], s["last_word"], s["cover"]) == ("mit-text", 2, 1 + n, 1.0)
    assert rows[1]["labels"] == "mit-text" and 0.6 < rows[1]["score"] < 1
    assert rows[2]["labels"] == "" and rows[4]["labels"] == "" and rows[3]["labels"] == "cc-by-nc-4.0"


def plain_spans(templates, words, min_match, max_gap, min_cover):
    """The same spans from all maximal matches, found by comparing every pair of places, with every chain kept open."""
    chains, found = [], []
    words = [w.encode() for w in words]
    for i in range(len(words)):
        for k, t in enumerate(templates):
            for j in range(len(t)):
                n = 0
                while i + n < len(words) and j + n < len(t) and words[i + n] == t[j + n]:
                    n += 1
                found.append((i, i + n - 1, n, k, j + n - 1))
    reach = {i: max(x[2] for x in found if x[0] == i) for i in range(len(words))}
    # a match counts if it is the longest of all templates from its start, and no longer one ends in the same word
    for i, end, n, k, at in sorted(found, key=lambda x: (x[1], x[3], x[4])):
        if n < min_match or n != reach[i] or (i and reach[i - 1] == n + 1):
            continue
        for c in reversed(chains):
            new = min(n, at - c[3], end - c[2])
            if c[0] == k and end - n - c[2] <= max_gap and new > 0 and at - new - c[3] <= max_gap:
                c[2:] = [end, at, c[4] + new]
                break
        else:
            chains.append([k, i, end, at, n])
    good = sorted(([str(k), a, b, c / len(templates[k]), c] for k, a, b, _, c in chains if c >= min_cover * len(templates[k])), key=lambda x: (-x[4], -x[3], x[1], x[0]))
    taken = []
    for x in good:
        if all(x[2] < y[1] or x[1] > y[2] for y in taken):
            taken.append(x)
    return sorted((tuple(x[:4]) for x in taken), key=lambda x: (x[1], x[0]))


def test_spans_against_every_match():
    rng = random.Random(5)
    for _ in range(60):
        templates = [[rng.choice("abcdefgh") * 2 for _ in range(rng.randrange(4, 14))] for _ in range(3)]
        scanner = licenses.Scanner({str(k): [" ".join(t)] for k, t in enumerate(templates)}, 2, 3, 0.5)
        words = []
        for _ in range(6):
            t = rng.choice(templates)
            a = rng.randrange(len(t))
            words += t[a : a + rng.randrange(2, 9)] + [rng.choice("xyab") * 2 for _ in range(rng.randrange(4))]
        assert scanner.spans([w.encode() for w in words]) == plain_spans([[w.encode() for w in t] for t in templates], words, 2, 3, 0.5)


def test_a_long_template_between_many_short_ones():
    long, short = [f"l{i}" for i in range(400)], [f"s{i}" for i in range(4)]
    scanner = licenses.Scanner({"long": [" ".join(long)]} | {f"s{k}": [" ".join(short)] for k in range(3)}, 4, 12, 0.6)
    words = [w for i in range(0, 400, 5) for w in long[i : i + 5] + short]
    assert ("long", 0, 80 * 9 - 5, 1.0) in scanner.spans([w.encode() for w in words])


def test_repeated_rows_and_an_empty_table(spark):
    df = spark.createDataFrame([(1, MIT, "x")] * 3, "doc_id long, text string, labels string")
    assert [r["labels"] for r in licenses.scan_licenses(df).collect()] == ["mit-text"] * 3
    assert licenses.scan_licenses(df.limit(0)).count() == 0


def test_automaton_knows_every_run():
    rng = random.Random(1)
    seqs = [[rng.randrange(3) for _ in range(rng.randrange(1, 12))] for _ in range(5)]
    a = licenses.Automaton(seqs)
    for _ in range(300):
        text = [rng.randrange(4) for _ in range(rng.randrange(1, 15))]
        for end, n, s in a.matches(text):
            run = text[end - n + 1 : end + 1]
            ends = {(k, i + n - 1) for k, q in enumerate(seqs) for i in range(len(q) - n + 1) if q[i : i + n] == run}
            assert ends and a.states[s].ends == ends
            longer = text[end - n : end + 1] if end >= n else None
            assert longer is None or not any(q[i : i + n + 1] == longer for q in seqs for i in range(len(q)))


def test_fingerprints_of_equal_and_edited_texts():
    rng = random.Random(2)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)).encode()
    other = " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)).encode()
    f = fingerprints.fingerprint
    assert f(text) == f(bytes(text)) and fingerprints.likeness(f(text), f(text)) == 1
    changed = text[:900] + b"CHANGED" + text[905:]
    assert fingerprints.likeness(f(text), f(changed)) > 0.8
    assert fingerprints.likeness(f(text), f(text + text[:500])) > 0.5
    assert fingerprints.likeness(f(text), f(other)) < 0.3
    assert f(b"") == "3::" and fingerprints.likeness("3::", f(b"a")) == 0


def test_fingerprint_is_the_same_in_parts(monkeypatch):
    rng = random.Random(3)
    texts = [bytes(rng.randrange(256) for _ in range(n)) for n in (1, 6, 7, 100, 3000)]
    whole = [fingerprints.fingerprint(t) for t in texts]
    monkeypatch.setattr(fingerprints, "SEGMENT", 64)
    assert [fingerprints.fingerprint(t) for t in texts] == whole


def test_rolling_hash_forgets():
    import numpy as np

    a, b = (np.frombuffer(x, np.uint8) for x in (b"abcdefghijklmno", b"ZZZdefghijklmno"))
    assert (fingerprints.rolling(a)[9:] == fingerprints.rolling(b)[9:]).all() and fingerprints.rolling(a)[3] != fingerprints.rolling(b)[3]


def test_edit_distance_against_the_table():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(12))) for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            last, row = row, [i + 1]
            for j, y in enumerate(b):
                row.append(last[j] if x == y else 1 + min(last[j + 1], row[j]))
        assert fingerprints.edit_distance(a, b) == row[-1]


@pytest.mark.parametrize("parts", [1, 3, 50])
def test_next_documents(spark, parts):
    import hashlib

    rng = random.Random(parts)
    ids = rng.sample(range(1000), 40)
    texts = {i: rng.choice(["", "é" * rng.randrange(9), "text number %d " % i * rng.randrange(1, 30)]) for i in ids}
    df = spark.createDataFrame([(i, t or None, 1) for i, t in texts.items()], "doc_id long, text string, part int").repartition(3)
    rows = {r["doc_id"]: r for r in fingerprints.fingerprint_edits(df, parts).collect()}
    order = sorted(ids)
    assert sorted(rows) == order
    for i, nxt in zip(order, order[1:] + order[:1]):
        t, n, k = texts[i], texts[nxt], len(texts[i]) // 4
        e = t[: len(t) - k] + n[:k]
        r = rows[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        f, g, h = (fingerprints.fingerprint(x.encode()) for x in (t, e, n))
        assert (r["fingerprint"], r["edited_fingerprint"]) == (f, g)
        assert (r["near_edited"], r["near_next"]) == (fingerprints.likeness(f, g), fingerprints.likeness(f, h))


def test_parts_grow_with_the_bytes(spark, monkeypatch):
    df = spark.createDataFrame([(i, "some words %d" % i) for i in range(300)] + [(None, None)], "doc_id int, text string")
    whole = sorted(fingerprints.fingerprint_edits(df).collect(), key=str)
    monkeypatch.setattr(fingerprints, "PART", 100)
    assert fingerprints.with_next(df).rdd.getNumPartitions() > 30
    assert sorted(fingerprints.fingerprint_edits(df).collect(), key=str) == whole and len(whole) == 301
    with pytest.raises(TypeError):
        fingerprints.fingerprint_edits(df.withColumn("doc_id", df["text"]))


def test_next_of_repeated_null_and_single_ids(spark):
    df = spark.createDataFrame([(None, "n"), (1, "b"), (1, "a"), (2, "c")], "doc_id long, text string")
    assert fingerprints.fingerprint_edits(df, 4).count() == 4
    one = fingerprints.fingerprint_edits(df.where("doc_id = 2"), 4).collect()
    assert one[0]["near_next"] == 1 and fingerprints.fingerprint_edits(df.limit(0), 4).count() == 0
    assert fingerprints.fingerprints(df).count() == 4


ITEM = "Anna Kovacs bought 12 apples for 3 dollars each at the old market. How much did Kovacs pay for all 12 apples on that day?"
BENCH = [(1, ITEM), (2, "too short here"), (3, None), (4, "Some entirely different question about rivers and mountains that nobody asks in the morning hours")]


def found(spark, texts, **more):
    docs = spark.createDataFrame([(i, t, 9) for i, t in enumerate(texts)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    rows = decontamination.contaminations(docs, bench, **more).collect()
    clean = {r["doc_id"] for r in decontamination.decontaminated(docs, bench, **more).collect()}
    assert clean == set(range(len(texts))) - {r["doc_id"] for r in rows}
    return {(r["doc_id"], r["item_id"]): r for r in rows}


@pytest.mark.parametrize("more", [{}, {"block_tokens": 10}])
def test_contaminations(spark, more):
    changed = ITEM.replace("Anna", "Maria").replace("Kovacs", "Silva").replace("12", "45").replace("3", "7")
    broken = ITEM.replace("12 apples for", "45 apples for")  # 12 meets 45 in one place and 12 in the other
    texts = ["Intro text. " + ITEM + " End.", "Here: " + changed, "A clean text about 12 apples and 3 dollars.", "", None, ITEM.lower(), "x. " + broken + " y"]
    got = found(spark, texts, **more)
    assert got[0, 1]["exact"] and got[0, 1]["coverage"] > 0.9
    assert not got[1, 1]["exact"] and got[1, 1]["n_tokens"] >= 13
    assert {d for d, _ in got} <= {0, 1, 5, 6} and (6, 1) not in got or got[6, 1]["n_tokens"] < got[0, 1]["n_tokens"]
    assert found(spark, []) == {}


def test_no_benchmark(spark):
    docs = spark.createDataFrame([(1, ITEM)], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contaminations(docs, none).count() == 0 and decontamination.decontaminated(docs, none).count() == 1


TOM = "Tom has 5 apples. Tom buys 3 more. How many apples does Tom have?"


def in_text(text, item=TOM):
    index = decontamination.Index([(1, item.encode())])
    return index.matches(text.encode(), decontamination.Codes(index.vocabulary), 13, 0.3)


def test_each_occurrence_has_its_own_slots():
    own = in_text("So: " + TOM)[0]
    assert own[2] >= 13 and own[4]
    for before in ("Tom has 9 apples. Tom buys 4 more. ", "Tom has 9 apples. Tom buys 5 more. And then " * 3, TOM.replace("5", "8") + " " + TOM.replace("3", "6") + " "):
        assert in_text(before + "Some other words stand here. " + TOM)[0][2:] == (14, 1.0, True)
    changed = TOM.replace("5", "70").replace("3", "21")  # neither the first nor exact
    assert in_text("Tom has 9 apples. Tom buys 4 more. Well. " + changed)[0][2:] == (14, 1.0, False)
    assert in_text("Tom has 9 apples. Tom buys 4 more. Well. Tom has 8 apples. Tom buys 2 more.") == []


def test_parts_that_lie_apart_still_add_up():
    words = "one river runs along seven green hills until evening while many old boats carry salt"
    first, second = words.split()[:8], words.split()[7:]
    assert in_text(" ".join(second) + " and so on " + " ".join(first), words)[0][2] == 15


def test_names_that_open_sentences_and_names_of_more_words():
    changed = "Sue has 9 apples. Sue buys 4 more. How many apples does Sue have?"
    assert in_text("Here. " + changed)[0][2:] == (14, 1.0, False)
    assert in_text("Here. " + changed.replace("Sue", "John Smith"))[0][2:] == (14, 1.0, False)
    assert in_text("Here. " + changed.replace("does Sue", "does Ann")) == []  # one name meets two
    mary = "Yesterday old Mary Jones gave 4 pears to each of the 6 boys because Mary Jones likes them"
    for name in ("Ann", "Ann Lee", "Ann Maria Lee"):
        assert in_text(mary.replace("Mary Jones", name).replace("4", "8"), mary)[0][3] == 1.0


def test_exact_copies_whatever_capitals():
    short = "Which river runs through Paris?"
    for item in (short, "Which river runs through the old town of Paris and 3 more?", TOM, ITEM):
        for text in ("Q: " + item, 'He asked, "' + item + '"', "now, " + item, item.lower(), item.upper(), item.title()):
            assert in_text(text, item)[0][3:] == (1.0, True), text
    assert in_text("Which river runs through the town?", short) == []


def test_lower_case_copy_is_found(spark):
    assert (0, 1) in found(spark, [ITEM.lower()])


def test_tables_of_numbers_are_no_items():
    rng = random.Random(2)
    table = lambda n: " ".join(str(rng.randrange(10**6)) for _ in range(n))
    items = [(i, table(60).encode()) for i in range(200)]
    index = decontamination.Index(items)
    codes = decontamination.Codes(index.vocabulary)
    began = time.time()
    assert index.matches(table(500).encode(), codes, 13, 0.3) == []
    assert [m[0] for m in index.matches(b"so " + items[7][1] + table(20).encode(), codes, 13, 0.3)] == [7]
    assert time.time() - began < 1
    # beside words, slots count: the values of the table meet others, one by one
    item = "Add up the numbers in this table of sales now: " + table(20)
    assert in_text("Add up the numbers in this table of sales now: " + table(20) + " and more", item)[0][3:] == (1.0, False)
    assert in_text("Add up the numbers in this table of sales now: " + "7 " * 20, item) == []


def test_work_grows_with_the_length_of_a_text():
    rng = random.Random(6)
    sheet = " ".join(TOM.replace("5", str(rng.randrange(90))).replace("3", str(rng.randrange(90))).replace("does Tom", "does Ann") for _ in range(400))
    began = time.time()
    assert not in_text(sheet)[0][4] and in_text(sheet + " " + TOM)[0][2:] == (14, 1.0, True)
    digits = lambda n: " plus ".join(str(rng.randrange(10)) for _ in range(n))
    in_text(digits(300), digits(40))
    assert in_text("the " * 20_000, "the " * 60)[0][3:] == (1.0, True)
    assert time.time() - began < 10


def plain_best(windows, length):
    """Every set, window by window."""

    def consistent(order):
        there, back, taken = {}, {}, []
        for w in order:
            if all(there.get(x, y) == y and back.get(y, x) == x for x, y in w[3]):
                there.update(w[3])
                back.update((y, x) for x, y in w[3])
                taken.append(w)
        return taken

    def size(ws):
        return len({i for _, a, b, _ in ws for i in range(a, b)}), all(x == y for w in ws for x, y in w[3])

    alike = [w for w in windows if size([w])[1]]
    sets = [consistent(o) for o in (windows, alike + [w for w in windows if w not in alike], alike)]
    left = [w for w in windows if not any(w in s for s in sets)]
    for part in {w[0] // (2 * length) - d for w in windows for d in (0, 1)}:
        own = [w for w in windows if w[0] // (2 * length) - part in (0, 1)]
        for i, w in enumerate(own):
            if w in left:
                near = lambda j: (own[j][0] - own[j][1] != w[0] - w[1], abs(own[j][0] - w[0]), j >= i, abs(j - i))
                sets.append(consistent([own[j] for j in sorted(range(len(own)), key=near)]))
    return max(size(s) for s in sets)


@pytest.mark.parametrize("seed", range(60))
def test_best_sets_against_every_set(seed):
    rng = random.Random(seed)
    windows, length = set(), rng.choice([6, 12, 30])
    for _ in range(rng.randrange(1, 40)):
        a = rng.randrange(length)
        pairs = {(0, b"%d" % rng.randrange(4)): (0, b"%d" % rng.randrange(4)) for _ in range(rng.randrange(3))}
        if len(set(pairs.values())) == len(pairs):
            windows.add((rng.randrange(60), a, min(length, a + 3), tuple(sorted(pairs.items()))))
    if windows:
        assert decontamination._best(sorted(windows), length)[:2] == plain_best(sorted(windows), length)


def plain_places(index, text, codes):
    """Items with their matching windows, by comparing each window with each place of the text."""
    raw_tokens, forms = decontamination.templates(text, codes)
    for k, (item_id, own, own_forms) in enumerate(index.items):
        found = set()
        for form, (ids, _) in enumerate(own_forms):
            w, there = min(decontamination.WINDOW, len(ids)), forms[form][0]
            if len(ids) < decontamination.LEAST:
                continue
            bare = lambda j: form != decontamination.PLAIN and max(ids[j : j + w]) < decontamination.FIRST_WORD
            same = [(i, j) for j in range(len(ids) - w + 1) for i in range(len(there) - w + 1) if (ids[j : j + w] == there[i : i + w]).all()]
            lines = {i - j for i, j in same if not bare(j)}
            found |= {index._window(k, form, i, j, w, raw_tokens, forms) for i, j in same if i - j in lines}
        windows = sorted(found - {None})
        need = max(min(13, len(own)), 0.3 * len(own))
        if windows and (best := plain_best(windows, len(own)))[0] >= need:
            yield item_id, best[0], best[0] / len(own), best[1]


@pytest.mark.parametrize("seed", range(25))
def test_matches_against_every_window(seed):
    rng = random.Random(seed)
    words = ["has", "buys", "apples", "Tom", "Ann", "3", "5", "how", "many", "Lee", "cost", "km", "."]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, make(rng.randrange(5, 30)).encode()) for i in range(6)]
    index = decontamination.Index(items)
    codes = decontamination.Codes(index.vocabulary)
    swap = {"Tom": "Bob", "3": "9", "5": "12", "Ann": "Eve"}
    parts = [make(8)]
    for _, t in rng.sample(items, 4):
        tokens = t.decode().split()
        parts += [" ".join(swap.get(x, x) if rng.random() < 0.95 else x for x in tokens), make(rng.randrange(6))]
    text = " ".join(parts).encode()
    got = [(m[0], *m[2:]) for m in index.matches(text, codes, 13, 0.3)]
    assert got == list(plain_places(index, text, codes)) and got
