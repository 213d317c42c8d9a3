"""Spelling variants, collocations and language identification against plain versions."""

import math
import random
import re
import zlib
from collections import Counter

import pytest

from slatewise.llm import collocations, language, variants


def ordered(frame_or_rows):
    found = frame_or_rows.collect() if hasattr(frame_or_rows, "collect") else frame_or_rows
    return sorted((tuple(r) for r in found), key=repr)


def latin(c):
    return "a" <= c <= "z" or "À" <= c <= "ÿ"


def plain_words(rows):
    counts = {}
    for doc_id, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for run in "".join(c if latin(c) else " " for c in low).split(" "):
            if run:
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                if h % 31 == 0:
                    at = h % len(run)
                    run = run[:at] + run[at + 1:]
                counts[run] = counts.get(run, 0) + 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def one_edit(x, y):
    if len(x) > len(y):
        x, y = y, x
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) == 1
    return len(y) == len(x) + 1 and any(y[:i] + y[i + 1:] == x for i in range(len(y)))


def plain_variants(rows):
    words, out = plain_words(rows), {}
    for w, n in words.items():
        near = [x for x in words if x != w and abs(len(x) - len(w)) < 2 and one_edit(w, x)]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        form = best if best and words[best] >= 10 * n else None
        out[w] = (n, len(near), form, words[form] if form else None)
    found = []
    for w, (n, near, form, form_n) in out.items():
        root = w
        while out[root][2]:
            root = out[root][2]
        found.append((w, n, near, form, form_n, root))
    return found


def spelled(seed, texts=60):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcé") for _ in range(rng.randint(6, 11))) for _ in range(40)]
    rows = []
    for i in range(texts):
        words = []
        for _ in range(rng.randint(0, 120)):
            w = base[min(int(rng.expovariate(0.15)), 39)]
            if rng.random() < 0.25:
                at = rng.randrange(len(w) + 1)
                w = w[:at] + rng.choice(["", "a", "é", "zz"]) + w[at + rng.randint(0, 1):]
            words.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((rng.choice([None, i, i, i, -i]), " ".join(words)))
    return rows + [(1, None), (2, ""), (3, "x" * 4000 + " " + "x" * 4000), (4, "x" * 3999 + " " + "x" * 3999), (5, "É" * 8 + " " + "é" * 8)] + rows[:3]


COLUMNS = ["word", "n", "n_near", "form", "form_n", "root"]


@pytest.mark.parametrize("seed,block", [(1, 4096), (2, 5)])
def test_variants(spark, seed, block, monkeypatch):
    """With a limit of five words nearly every block is halved down to one place."""
    monkeypatch.setattr(variants, "BLOCK", block)
    rows = spelled(seed)
    docs = spark.createDataFrame([(i, t, "w", 1, 2, 3) for i, t in rows], "doc_id long, text string, word string, n long, block long, m long").repartition(3)
    assert ordered(variants.variants(docs).select(COLUMNS)) == ordered(plain_variants(rows))


def test_variants_of_awkward_documents(docs, no_docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert ordered(variants.variants(docs).select(COLUMNS)) == ordered(plain_variants(rows))
    assert variants.variants(no_docs).count() == 0


def test_chains_of_forms(spark):
    chain = [("aaaaaaa", 2), ("aaaaaab", 30), ("aaaaabb", 400), ("aaaabbb", 9000)]
    docs = spark.createDataFrame([(None, " ".join([w] * n)) for w, n in chain], "doc_id long, text string")
    kept = {w for w, n in chain if zlib.crc32(f":{w}".encode()) % 31}
    found = {r.word: r for r in variants.variants(docs).collect()}
    assert kept == set(found) == {w for w, _ in chain}
    assert {r.root for r in found.values()} == {"aaaabbb"} and found["aaaaaaa"].form == "aaaaaab"


def plain_collocations(rows, least, top):
    counts, out = Counter(), []
    for lang, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            words = [w for w in re.split("[ \t]+", piece) if w]
            for size in (1, 2, 3, 4):
                counts.update((lang or "und", tuple(words[i:i + size])) for i in range(len(words) - size + 1))
    totals = Counter()
    for (lang, p), n in counts.items():
        totals[lang] += n * (len(p) == 1)
    rated = {}
    for (lang, p), a in counts.items():
        if a >= least and len(p) > 1:
            rated[lang, p] = min((2000000 * a // (counts[lang, p[:k]] + counts[lang, p[k:]]), k, counts[lang, p[:k]], counts[lang, p[k:]])
                                 for k in range(1, len(p)))
    for lang in totals:
        kept = []
        for (x, p), (score, _, left, right) in rated.items():
            longer = [counts[o] for o in rated if o[0] == lang and len(o[1]) > len(p) and any(o[1][i:i + len(p)] == p for i in range(len(o[1])))]
            if x == lang and not any(100 * f >= 80 * counts[x, p] for f in longer):
                kept.append((-score, -counts[x, p], " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -score))
    return out


def phrased(seed):
    rng = random.Random(seed)
    words = ["a", "B", "été", "É", "the", "of", "x", "no-stop", "\u00a0", "\x1c", "'", "\U0001f600"]
    said = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 7))) for _ in range(12)]
    rows = []
    for i in range(80):
        parts = [rng.choice(said) if rng.random() < 0.7 else rng.choice(words) for _ in range(rng.randint(0, 12))]
        rows.append((rng.choice(["en", "de", None, "und"]), "".join(p + rng.choice([" ", "  ", "\t", ". ", "\n", "\x0b", ", ", "?", " \x85 "]) for p in parts)))
    return rows + [("en", None), ("fr", ""), ("fr", " .. "), ("en", "ha " * 3000), ("en", "x " * 7)] + rows[:5]


@pytest.mark.parametrize("seed,least,top,period", [(1, 8, 2000, 2), (2, 3, 5, 3), (3, 30, 2000, 32)])
def test_collocations(spark, seed, least, top, period, monkeypatch):
    monkeypatch.setattr(collocations, "LEAST", least)
    monkeypatch.setattr(collocations, "PERIOD", period)
    monkeypatch.setattr(collocations, "HELD_BYTES", 3000)
    rows = phrased(seed)
    docs = spark.createDataFrame([(lang, t, "p", 1, 2) for lang, t in rows], "lang string, text string, phrase string, a long, n long").repartition(3)
    found = collocations.collocations(docs, top)
    assert ordered(found) == ordered(plain_collocations(rows, least, top))
    assert found.count() > 2


def test_collocations_of_an_empty_table(no_docs):
    assert collocations.collocations(no_docs).count() == 0


def test_chunks_own_every_phrase_once():
    rng = random.Random(5)
    for _ in range(200):
        words = [rng.choice(["a", "b", "c", "d"]).encode() for _ in range(rng.randint(0, 30))]
        found = collocations.chunks(b" ".join(words), {w: w == b"a" for w in (b"a", b"b", b"c", b"d")})
        got = Counter()
        for chunk in found:
            inner, last = chunk.split(), chunk.endswith(b"\n")
            for i in range(len(inner) - (0 if last else collocations.WINDOW)):
                got.update(tuple(inner[i:i + n]) for n in (1, 2, 3, 4) if i + n <= len(inner))
        assert got == Counter(tuple(words[i:i + n]) for i in range(len(words)) for n in (1, 2, 3, 4) if i + n <= len(words))
        assert sum(c.endswith(b"\n") for c in found) == bool(words)


def plain_language(rows, sample):
    """Scores of every row from a model counted over the sample rows, term by term; the model tables hold every term here."""
    langs = [x for x, _ in sorted(Counter(x for x, _ in sample).items(), key=lambda kv: (-kv[1], kv[0]))]

    def split(t):
        words = re.findall(r"[^\W\d_]+", (t or "").lower())
        return words if any(c.isalpha() for w in words for c in w) else []

    counts = [{x: Counter() for x in langs} for _ in range(5)]
    for lang, text in sample:
        for w in split(text):
            counts[0][lang][w] += 1
            for n in (1, 2, 3, 4):
                framed = w if n == 1 else f" {w} "
                for i in range(len(framed) - n + 1):
                    counts[n][lang][framed[i:i + n]] += 1
    size = Counter(x for x, _ in sample)

    def logs(n, term):
        kinds = sum(len(counts[n][x]) for x in langs)
        return [math.log((counts[n][x][term] + 0.3) / (sum(counts[n][x].values()) + 0.3 * (kinds + 1))) for x in langs]

    def word(w):
        if any(counts[0][x][w] for x in langs):
            return logs(0, w)
        for n in (4, 3, 2, 1):
            framed = w if n == 1 else f" {w} "
            known = [g for g in (framed[i:i + n] for i in range(len(framed) - n + 1)) if any(counts[n][x][g] for x in langs)]
            if known:
                each = [logs(n, g) for g in known]
                return [sum(c) / len(known) for c in zip(*each)]
        return [0.0] * len(langs)

    out = []
    for text in rows:
        words = split(text)
        if not words:
            out.append(("und", 0.0))
            continue
        total = [math.log(size[x] / len(sample)) for x in langs]
        for w in words:
            total = [a + b for a, b in zip(total, word(w))]
        best = max(total)
        out.append((langs[total.index(best)], 1 / sum(math.exp(t - best) for t in total)))
    return out


def test_language_by_a_plain_model(spark):
    rng = random.Random(4)
    stems = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["ka", "schu", "mü", "ßen"], "cc": ["жа", "ко", "ми", "ka"]}
    rows = []
    for i in range(90):
        lang = rng.choice(list(stems))
        text = " ".join("".join(rng.choice(stems[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 12)))
        rows.append((i, text.title() if i % 3 else text, rng.choice([lang, lang, lang, None])))
    rows += [(200, None, "aa"), (201, "", "aa"), (202, "12 _ ² ½ --", "bb"), (None, "ka lo", "aa"), (203, "日本 xyz", None), (204, "q", "zz")] + rows[:4]
    docs = spark.createDataFrame([(i, t, x, "s", 1, "e") for i, t, x in rows],
                                 "doc_id long, text string, lang string, term string, n long, draw string").repartition(3)
    kept = lambda i: i is not None and zlib.crc32(str(i).encode()) % 3 != 1
    sample = [(x, t) for i, t, x in rows if x and t is not None and kept(i)]
    found = language.identify(docs, language.learn(docs)).collect()
    want = Counter((i, i is not None and zlib.crc32(str(i).encode()) % 3 == 1, x, round(s, 6))
                   for (i, _, _), (x, s) in zip(rows, plain_language([t for _, t, _ in rows], sample)))
    got = Counter((r.doc_id, r.held_out, r.lang_pred, round(r.score, 6)) for r in found)
    assert not (got - want) and not (want - got)


def test_language_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE", 5)
    docs = spark.createDataFrame([(7, "same row", "hot")] * 300 + [(i, f"text {i}", "cold") for i in range(30)], "doc_id long, text string, lang string")
    sample, sizes = language.labelled_sample(docs)
    assert Counter(r.lang for r in sample.collect()) <= Counter({"hot": 5, "cold": 5}) and len(sizes) in (1, 2)


def test_language_without_anything_to_learn(spark, no_docs):
    assert language.identify(no_docs, language.learn(no_docs)).count() == 0
    docs = spark.createDataFrame([(1, "word", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in language.identify(docs, language.learn(docs)).collect()} == {("und", 0.0)}


def test_language_of_held_out_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = language.identify(docs, language.learn(docs)).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(found) > 30 and sum(r.lang == r.lang_pred for r in found) >= 0.95 * len(found)
