"""SimHash classes, components and suffix deduplication against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash

from slatewise.llm import components, simhash, suffix_dedup
from slatewise.llm.suffix_array import suffix_array

ordered = lambda x: sorted((tuple(r) for r in (x.collect() if hasattr(x, "collect") else x)), key=repr)


def plain_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in lowered + " ":
        if c in " \t\n\x0b\x0c\r":
            words, word = words + [word] * bool(word), ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 4 and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {}
    for (doc_id, _), x in zip(rows, label):
        if doc_id is not None:
            least[x] = min(doc_id, least.get(x, doc_id))
    return [(d, f"{p:016x}", least.get(x)) for (d, _), p, x in zip(rows, prints, label)]


def test_classes(docs, no_docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    found = simhash.classes(docs).select("doc_id", simhash.hex_digits("fingerprint"), "component_id")
    assert ordered(found) == ordered(plain_classes(rows))
    assert simhash.classes(no_docs).count() == 0


def test_keep_one_row_per_class(docs, no_docs):
    kept = simhash.keep_one(docs)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    classes = {(d is None and f) or c for d, f, c in plain_classes(rows)}
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect() if r.doc_id is not None]
    assert sorted(ids) == sorted({c for _, _, c in plain_classes(rows) if c is not None})
    assert kept.count() >= len(ids) and len(classes) >= len(ids)
    assert simhash.keep_one(no_docs).count() == 0


def test_keep_one_leaves_other_columns_alone(docs):
    named = docs.withColumnRenamed("uid", "_name").withColumnRenamed("row", "_Name_")
    kept = simhash.keep_one(named)
    assert kept.columns == named.columns and kept.count() == simhash.keep_one(docs).count()


@pytest.mark.parametrize("seed", range(6))
def test_trie_join_finds_every_component(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, size=40, dtype=np.int64)
    found = set()
    for x in rng.choice(base, 400):
        x = int(x)
        for b in rng.integers(0, 64, size=rng.integers(0, 7)):
            x ^= 1 << int(b)
        found.add(x)
    prints = np.array(sorted(found), "u8")
    branch = (prints >> np.uint64(61)).astype(np.int64) if seed % 2 else np.zeros(len(prints), np.int64)

    def classes(pairs):
        label = {int(p): int(p) for p in prints}
        for a, b in pairs:
            a, b = label[a], label[b]
            label = {k: (min(a, b) if v in (a, b) else v) for k, v in label.items()}
        return label

    u, v = simhash.trie_links(branch, prints)
    every = [(int(a), int(b)) for i, a in enumerate(prints) for j, b in enumerate(prints[:i])
             if branch[i] == branch[j] and int(a ^ b).bit_count() <= 4]
    assert classes(zip(u.tolist(), v.tolist())) == classes(every)
    assert len(u) < len(prints)


def test_crowded_branches_lose_no_link(spark, monkeypatch):
    rng = random.Random(3)
    center, prints = rng.getrandbits(64), set()
    while len(prints) < 300:
        x = center
        for _ in range(rng.randint(0, 9)):
            x ^= 1 << rng.randrange(64)
        prints.add(x)
    prints = sorted(prints)
    monkeypatch.setattr(simhash, "BRANCH", 20)
    frame = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fingerprint long")
    found = {r.node: r.root for r in components.components(simhash.links(frame)).collect()}
    label = {p: p for p in prints}
    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= 4 and label[a] != label[b]:
                x, y = label[a], label[b]
                label = {k: (y if v == x else v) for k, v in label.items()}
    groups = lambda d: sorted(sorted(k for k in d if d[k] == r) for r in set(d.values()))
    mine = {p: found.get(p - (1 << 64) if p >> 63 else p, p) for p in prints}
    assert groups(mine) == groups(label)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7), (5, 6), (6, 5), (200, 199)]
    found = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {i: 0 for i in range(41)} | {100 + k: 100 for k in range(30)} | {199: 199, 200: 199}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_suffix_array():
    rng = random.Random(2)
    for _ in range(1500):
        text = [rng.randint(0, rng.choice([0, 1, 2, 5])) for _ in range(rng.randint(0, 40))]
        assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def plain_dedup(rows):
    first, coded = {}, [(suffix_dedup.LAST if i is None else i, (t or "").encode()) for i, t in rows]
    for i, b in coded:
        for s in range(len(b) - 49):
            first[b[s:s + 50]] = min(first.get(b[s:s + 50], i), i)
    out = []
    for (name, _), (i, b) in zip(rows, coded):
        gone = bytearray(len(b) + 1)
        for s in range(len(b) - 49):
            if first[b[s:s + 50]] < i:
                gone[s:s + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((name, len(b), sum(gone), sum(g and not gone[k - 1] for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("limits", [{}, {"chunk": 3000, "crowded": 1, "crowded_all": 2}, {"chunk": 20_000, "crowded_all": 1}])
def test_suffix_dedup(docs, limits):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert ordered(suffix_dedup.deduplicate(docs, **limits)) == ordered(plain_dedup(rows))


def test_suffix_dedup_of_passages(spark, no_docs, tmp_path):
    rng = random.Random(5)
    passages = ["".join(rng.choice(["the ", "of ", "tion", "and ", "x" * 30]) for _ in range(30)) for _ in range(5)]
    made = ["".join(rng.choice([rng.choice(passages), rng.choice(passages)[rng.randint(0, 60):],
                                "".join(rng.choice("abcdef ghé") for _ in range(rng.randint(0, 99)))]) for _ in range(rng.randint(0, 4)))
            for _ in range(150)]
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame([(i // 2 * 2 if i % 9 == 0 else i, t) for i, t in enumerate(made)], "doc_id long, text string").repartition(4).write.parquet(path)
    given = spark.read.parquet(path)
    rows = [tuple(r) for r in given.collect()]
    assert ordered(suffix_dedup.deduplicate(given)) == ordered(plain_dedup(rows))
    kept = suffix_dedup.deduplicate(given, keep_text=True)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and len(r.kept) == r.n_bytes - r.n_removed for r in kept.collect())
    assert suffix_dedup.deduplicate(no_docs).count() == 0


def test_long_steps_keep_every_start():
    text = bytes(random.Random(1).choices(b"abcde", k=5000))
    doc, start, count, _, _, _ = suffix_dedup.chunk_stretches([text, b"", text[:49], text[:50]], True)
    covered = sorted((d, s + k) for d, s, n in zip(doc.tolist(), start.tolist(), count.tolist()) for k in range(n))
    assert covered == [(0, s) for s in range(len(text) - 49)] + [(3, 0)]


@pytest.mark.parametrize("seed", range(8))
def test_repeated_starts_of_parts_around_one_anchor(seed):
    """Parts with more or less in common on both sides of their anchor, zero bytes and equal parts among them."""
    rng = random.Random(seed)
    anchor = bytes(rng.randrange(256) for _ in range(suffix_dedup.ANCHOR))
    sides = [bytes(rng.choice(b"ab\0") for _ in range(40)) for _ in range(4)]
    parts, owners, leads = [], [], []
    for _ in range(rng.randint(2, 12)):
        left, right = (bytearray(rng.choice(sides)) for _ in range(2))
        for side in (left, right):
            if rng.random() < 0.6:
                side[rng.randrange(len(side))] ^= 1
        lead, rest = rng.randint(0, 25), rng.randint(0, 25)
        if lead + rest >= suffix_dedup.LENGTH - suffix_dedup.ANCHOR:
            parts.append(bytes(left[len(left) - lead:]) + anchor + bytes(right[:rest]))
            owners.append(rng.randint(1, 5))
            leads.append(lead)
    want = []
    for k, part in enumerate(parts):
        for at in range(max(0, leads[k] + suffix_dedup.ANCHOR - 50), min(leads[k], len(part) - 50) + 1):
            if any(owners[o] < owners[k] and part[at:at + 50] in other for o, other in enumerate(parts)):
                want.append((k, at))
    assert sorted(suffix_dedup.repeated_starts(parts, owners, leads)) == sorted(want)
