"""Operators against brute force on small fixtures, with the awkward rows in every table."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import xxhash
from pyspark.sql import functions as F

pytest.importorskip("graphlake.llm")

from graphlake.llm import backoff_lm, bm25, components, decontaminate, license_scan, line_dedup, ngram_join, packing, quote_linking, toxicity, url_filter  # noqa: E402

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOC = "doc_id long, text string, n_words long, pos int, key string"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WORD.findall(lower(text))


def blank_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def corpus(n=60, seed=1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeäÉ") for _ in range(rng.randint(1, 6))) for _ in range(120)]
    line = lambda: " ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 25)))
    shared = [line() for _ in range(4)]
    texts = ["\n".join([line() for _ in range(rng.randint(1, 6))] + rng.sample(shared, rng.randint(0, 3))) for _ in range(n)]
    texts += [None, "", " ", "\n\n", "one", "ONE", "!!!", "a b c", texts[0], texts[0].upper(), texts[1] + " tail", " ".join(texts[2].split(" ")[1:])]
    texts += ["x " * 5000, texts[3], texts[3]]
    rows = [(i, t, 7, 1, "clash") for i, t in enumerate(texts)]
    rows += [rows[5], (None, texts[4], 0, 0, None), (None, None, None, None, None), (10_000, "the same id", 1, 1, ""), (10_000, "another text", 1, 1, "")]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOC).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def unique(rows):
    """Rows as documents: repeated ones once."""
    return list(dict.fromkeys((r[0], r[1] or "") for r in rows))


# --- line deduplication


def line_key(line):
    return lower(line.strip(" \t\n\x0b\x0c\r"))


@pytest.mark.parametrize("least", [2, 10])
def test_line_dedup_matches_brute_force(docs, rows, least):
    holders = defaultdict(set)
    for d in unique(rows):
        for line in d[1].split("\n"):
            holders[line_key(line)].add(d)
    bad = {k for k, v in holders.items() if k and len(v) >= least}
    want = Counter()
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if line_key(x) not in bad]
        want[r[0], "\n".join(kept), len(lines), len(lines) - len(kept), r[4]] += 1
    got = line_dedup.dedup_lines(docs, least)
    assert got.columns == ["doc_id", "text", "pos", "key", "n_lines", "n_dropped"] or "n_words" in got.columns
    assert Counter((r.doc_id, r.text, r.n_lines, r.n_dropped, r.key) for r in got.collect()) == want
    assert bad


def test_line_dedup_of_an_empty_table(empty):
    assert line_dedup.dedup_lines(empty).count() == 0


# --- decontamination


@pytest.mark.parametrize("span", [4, 8])
def test_decontamination_matches_brute_force(spark, docs, rows, span):
    rng = random.Random(2)
    items = []
    for i in range(25):
        text = rng.choice([r[1] for r in rows if r[1] and len(r[1]) < 4000])
        w = text.split()
        at = rng.randrange(max(1, len(w)))
        items.append((i, " ".join(["zz"] * rng.randint(0, 3) + w[at : at + rng.randint(2, 30)])))
    items += [(50, None), (51, ""), (52, "one"), (53, "X x X"), (54, "x " * 30), (None, items[0][1]), (0, items[1][1]), (0, items[1][1])]
    bench = spark.createDataFrame([(i, t, "u") for i, t in items], "item_id long, text string, doc_id string")
    got = decontaminate.scan_contamination(docs, bench, span)
    got = got.select("doc_id", "n_words", decontaminate.hit_words(F.col("hits")).alias("h"), decontaminate.hit_items(F.col("hits")).alias("i"))
    want = Counter()
    for r in rows:
        w, hit, ids = words(r[1]), set(), set()
        for item, text in items:
            v = words(text)
            n = min(len(v), span)
            for j in range(len(v) - n + 1 if n else 0):
                for i in range(len(w) - n + 1):
                    if w[i] == v[j] and w[i : i + n] == v[j : j + n]:
                        hit |= set(range(i, i + n))
                        ids.add(item)
        want[r[0], len(w), len(hit), tuple(sorted(str(i) for i in ids if i is not None))] += 1
    assert Counter((r.doc_id, r.n_words, r.h, tuple(x for x in r.i if x is not None)) for r in got.collect()) == want
    assert any(k[3] for k in want)


def test_decontamination_of_empty_tables(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.scan_contamination(empty, none).count() == 0
    assert decontaminate.scan_contamination(docs, none).filter(F.size("hits") > 0).count() == 0
    assert decontaminate.drop_contaminated(docs, none).count() == docs.count()


# --- shingle join


def shingle_groups(rows, percent=75):
    docs = unique(rows)
    sets = []
    for _, text in docs:
        w = blank_words(text)
        n = min(len(w), 5)
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set())
    up = list(range(len(docs)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                up[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (d, _) in enumerate(docs):
        r = root(i)
        least[r] = d if least.get(r) is None else least[r] if d is None else min(d, least[r])
    return {d: (len(sets[i]), least[root(i)]) for i, d in enumerate(docs)}


def near_rows(seed=5, n=40):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.randint(40, 60))] for _ in range(n // 10)]
    passage = " ".join(f"p{i}" for i in range(30))
    out = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 1)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        out.append((i + 100, " ".join(w) + (" " + passage if rng.random() < 0.5 else ""), 1, 1, "k"))
    return out


@pytest.mark.parametrize("paired,block", [(256, 4000), (2, 4), (1, 3)])
def test_shingle_components_match_brute_force(spark, rows, monkeypatch, paired, block):
    monkeypatch.setattr(ngram_join, "PAIRED", paired)
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", block)
    every = rows + near_rows()
    docs = spark.createDataFrame(every, DOC).repartition(4)
    want = shingle_groups(every)
    got = ngram_join.shingle_components(docs)
    pairs = Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect())
    assert pairs == Counter((r[0], *want[r[0], r[1] or ""]) for r in every)
    assert max(Counter(c for _, c in want.values() if c is not None).values()) > 3


def test_tree_finds_all_links_of_a_large_group():
    rng = np.random.default_rng(3)
    core = rng.integers(0, 2**63, 200).astype(np.uint64)
    sets = [np.unique(np.concatenate([core[rng.random(200) > p], rng.integers(0, 2**63, int(200 * p)).astype(np.uint64)])) for p in rng.uniform(0, 0.4, 150)]
    got = ngram_join.Forest()
    for a, b in ngram_join.tree_links(np.arange(150), sets, 75):
        got.join(a, b)
    want = ngram_join.Forest()
    for i in range(150):
        for j in range(i):
            n = len(np.intersect1d(sets[i], sets[j]))
            if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                want.join(i, j)
    assert [got.root(i) for i in range(150)] == [want.root(i) for i in range(150)]


def test_keep_one_keeps_one_of_each_group(spark, rows):
    every = rows + near_rows()
    docs = spark.createDataFrame(every, DOC)
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    want = shingle_groups(every)
    groups = Counter()
    for r in kept.collect():
        n, c = want[r.doc_id, r.text or ""]
        if n:
            groups[c] += 1
            assert r.doc_id == c
    assert set(groups) == {c for n, c in want.values() if n}


def test_shingle_components_of_an_empty_table(empty):
    assert ngram_join.shingle_components(empty).count() == 0


# --- connected components


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(1000 + rng.randrange(300), 1000 + rng.randrange(300)) for _ in range(150)] + [(5000, x) for x in range(5001, 5200)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    want = ngram_join.Forest()
    for a, b in edges:
        if a is not None and a != b:
            want.join(a, b)
    ends = {x for a, b in edges if a is not None and a != b for x in (a, b)}
    assert got == {x: want.root(x) for x in ends}
    assert components.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


# --- license scan


def test_license_scan_matches_brute_force(spark, docs, rows):
    texts = [r[1] for r in rows[:10]] + [
        "Licensed under CC BY-NC 4.0.", "cc by cc by CC-BY", "general\npublic license", "The GNU General Public License, version 3: this work is licensed under",
        "all rights reserved worldwide, and all rights reserved", "public general license", "rights reserved all", None, "",
    ]
    every = [(i, t, 1, 1, "k") for i, t in enumerate(texts)] + [(3, texts[3], 1, 1, "k"), (None, texts[10], 1, 1, "k")]
    templates = {label: [set(words(t)) for t in ts] for label, ts in license_scan.TEMPLATES.items()}
    want = Counter()
    for r in every:
        w = words(r[1])
        at = [(i, label) for p, label in license_scan.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        found = {}
        for line in (r[1] or "").split("\n"):
            has = set(words(line))
            for label, ts in templates.items():
                for t in ts:
                    if len(t & has) >= math.ceil(round(0.8 * len(t), 9)):
                        found[label] = max(found.get(label, 0), len(t & has) / len(t))
        want[r[0], len(w), tuple(sorted(at)), tuple(sorted(found.items()))] += 1
    got = license_scan.scan_licenses(spark.createDataFrame(every, DOC))
    assert Counter((r.doc_id, r.n_words, tuple(sorted((p.at, p.label) for p in r.places)), tuple(sorted((m.label, m.containment) for m in r.matches))) for r in got.collect()) == want
    assert license_scan.scan_licenses(docs.limit(0)).count() == 0
    assert license_scan.scan_licenses(docs, templates={}, phrases={}).count() == len(rows)


# --- packing


def test_packing_is_a_round_trip_without_padding(spark, docs, rows, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    got = packing.pack_documents(docs, path, window=64).collect()
    sequences = defaultdict(list)
    for r in got:
        assert len(r.ids) == 4 * r.length > 0
        sequences[r.sequence_id].append(r)
    for s in sequences.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == [sum(x.length for x in s[:i]) for i in range(len(s))]
        n = sum(r.length for r in s)
        assert n == 64 or n & (n - 1) == 0
    parts = defaultdict(list)
    for r in sorted(got, key=lambda r: r.start):
        parts[r.doc_id, r.doc_tokens].append(r)
    want = Counter((r[0], tuple([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1])) for r in rows)
    total = Counter()
    for (i, ids), n in want.items():
        total[i, len(ids)] += n
    assert {k: sum(r.length for r in v) for k, v in parts.items()} == {k: k[1] * n for k, n in total.items()}
    for (i, ids), n in want.items():
        if n == 1 and total[i, len(ids)] == 1:
            own = parts[i, len(ids)]
            assert tuple(np.frombuffer(b"".join(r.ids for r in own), "<u4").tolist()) == ids
            assert [r.start for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
    assert packing.pack_documents(empty, path).count() == 0


def test_sum_of_squares_places_as_defined():
    rng = random.Random(6)
    for _ in range(30):
        packer = packing.SumOfSquares(16)
        counts = [0] * 17
        for k in range(40):
            size = rng.randint(1, 15)
            cost = {}
            for level in [0] + [x for x in range(1, 17 - size) if counts[x]]:
                after = counts.copy()
                if level:
                    after[level] -= 1
                if level + size < 16:
                    after[level + size] += 1
                cost[level] = sum(x * x for x in after)
            packer.add(k, b"abcd" * size)
            now = packer.counts.tolist()
            assert sum(x * x for x in now) == min(cost.values())
            counts = now
        packer.drain()
        assert sum(r[2] for r in packer.out) == sum(len(r[3]) // 4 for r in packer.out)


# --- toxicity


def test_toxicity_learns_words_and_not_groups():
    rng = random.Random(7)
    plain = [f"w{i}" for i in range(300)]
    texts, labels = [], []
    for i in range(600):
        w = rng.sample(plain, 12)
        toxic = i % 3 == 0
        if toxic:
            w.append("scum")
        if rng.random() < (0.8 if toxic else 0.1):  # groups are named far more often where it is toxic
            w.append(rng.choice(["muslim", "muslims"]))
        rng.shuffle(w)
        texts.append(" ".join(w))
        labels.append(int(toxic))
    sets = [toxicity.features(t) for t in texts]
    pairs = [(s, toxicity.features(o)) for s, t in zip(sets, texts) if (o := toxicity.swapped(t))]
    plainly, fairly = toxicity.fit(sets, np.array(labels)), toxicity.fit(sets, np.array(labels), pairs)
    neutral = "a muslim family from " + " ".join(plain[:5])
    other = neutral.replace("muslim", "christian")
    gap = lambda m: abs(m.margin(toxicity.features(neutral)) - m.margin(toxicity.features(other)))
    assert gap(fairly) < 0.5 * gap(plainly)
    assert fairly.score(neutral) < 0.7 <= fairly.score("you scum " + plain[0])
    assert toxicity.fit([], np.zeros(0)).score("x") == pytest.approx(0.5)
    assert toxicity.fit(sets[:1], np.array([0])).score(None) < 0.5


def test_groups_are_swapped_in_all_languages():
    for text in ("the muslims came", "les immigrés arrivent", "die Flüchtlinge kommen", "los judíos vienen", "Muslime und Frauen", "una mujer"):
        other = toxicity.swapped(text)
        assert other is not None and other != text.lower() and len(other.split()) == len(text.split())
    listed = [w for line in toxicity.IDENTITY for w in line.split()]
    assert len(listed) == len(set(listed))
    assert toxicity.swapped("le graphe des appels") is None


def test_toxicity_on_tables(spark, docs, empty):
    rows = [(i, ("idiot " if i % 4 == 0 else "") + f"some w{i % 7} text w{i % 11}", 1, 1, "k") for i in range(300)]
    table = spark.createDataFrame(rows, DOC)
    labels = spark.createDataFrame([(i, int(i % 4 == 0), 1) for i in range(300)] + [(None, 1, 1), (3, None, 1)], "doc_id long, toxic int, quality int")
    model = toxicity.train_classifier(table, labels)
    got = toxicity.score_toxicity(table, model).collect()
    assert all((r.score >= 0.7) == (r.doc_id % 4 == 0) for r in got)
    assert toxicity.score_toxicity(docs, model).filter("score BETWEEN 0 AND 1").count() == docs.count()
    assert toxicity.score_toxicity(empty, model).count() == 0
    held = table.select("doc_id", toxicity.held_out("doc_id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in held)
    toxicity.train_classifier(empty, labels.limit(0))


# --- BM25


@pytest.mark.parametrize("few", [0, 3, 16])
def test_search_matches_brute_force(spark, docs, rows, empty, monkeypatch, few):
    monkeypatch.setattr(bm25, "TERM_BLOCK", 100)
    index = bm25.build_index(docs, shard_words=100)
    assert index.count() > 16 and index.select("level").distinct().count() > 1
    n, mean = bm25.corpus_statistics(index)
    frequencies = bm25.document_frequencies(index)
    queries = docs.filter("doc_id % 4 = 0").select(F.col("doc_id").alias("query_id"), "text").dropDuplicates(["query_id"])
    terms = bm25.key_terms(queries, frequencies, n, most=6)
    got = defaultdict(list)
    for r in bm25.search(index, terms, k=5, few=few).collect():
        got[r.query_id].append((r.rank, r.doc_id, r.score))
    wanted, df = defaultdict(dict), {}
    for r in terms.collect():
        wanted[r.query_id][r.term] = r.df
    bags = [(r[0], bm25.term_counts((r[1] or "").encode())) for r in rows if r[0] is not None]
    assert n == len(bags)
    for q, ts in wanted.items():
        scores = []
        for d, (own, count, length) in bags:
            tf = dict(zip(own.tolist(), count.tolist()))
            s = sum(math.log(1 + (n - ts[t] + 0.5) / (ts[t] + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * length / mean)) for t in ts if t in tf)
            if s:
                scores.append((-round(s, 9), d))
        best = sorted(scores)[:5]
        assert [(i, pytest.approx(-s, abs=1e-8)) for i, (s, _) in enumerate(best, 1)] == [(r, s) for r, _, s in sorted(got[q])]
        assert [d for _, d, _ in sorted(got[q])] == [d for _, d in best]
    none = bm25.build_index(empty)
    assert bm25.search(none, terms.limit(0)).count() == 0
    assert bm25.search(index, terms.limit(0)).count() == 0


def test_registered_search_takes_whole_texts(spark, tmp_path, monkeypatch):
    from graphlake.llm.registry import op2_topk_search

    monkeypatch.setattr(bm25, "TERM_BLOCK", 300, raising=False)
    rows = [(10 * i, r[1]) for i, r in enumerate(corpus(90)) if r[0] is not None] + [(5, "only here " + " ".join(f"w{i}" for i in range(40)))]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    bags = [(d, Counter(words(t))) for d, t in rows]
    n, mean, df = len(bags), sum(sum(b.values()) for _, b in bags) / len(bags), Counter(w for _, b in bags for w in b)
    got = defaultdict(list)
    for r in op2_topk_search(spark, str(tmp_path)).collect():
        got[r.query_id].append((r.rank, r.doc_id, r.score))
    longest = 0
    for q, terms in bags:
        if q % 50:
            continue
        longest = max(longest, len(terms))
        found = []
        for d, b in bags:
            s = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * b[t] * 2.2 / (b[t] + 1.2 * (0.25 + 0.75 * sum(b.values()) / mean)) for t in terms if t in b)
            if s:
                found.append((-round(s, 9), d))
        want = [(i, d, pytest.approx(-s, abs=1e-8)) for i, (s, d) in enumerate(sorted(found)[:10], 1)]
        assert sorted(got[q]) == want
    assert longest > 40


@pytest.mark.parametrize("dense", [1, 300, 8_000_000])
def test_many_terms_are_added_up_exactly(monkeypatch, dense):
    monkeypatch.setattr(bm25, "DENSE", dense)
    monkeypatch.setattr(bm25, "SPREAD", 100)
    monkeypatch.setattr(bm25, "PANEL", 700)
    rng = np.random.default_rng(3)
    n = 150
    lists = [np.sort(rng.choice(n, rng.integers(1, n), replace=False)).astype(np.uint32) for _ in range(60)]
    gains = [rng.choice([0.5, 1.0, 0.25], len(x)) for x in lists]
    held = bm25.Postings(np.concatenate(lists), np.concatenate(gains), np.array([len(x) for x in lists]), n)
    wanted = [np.sort(rng.choice(60, rng.integers(17, 60), replace=False)) for _ in range(25)]
    ids, heaps = (np.arange(n) * 3).tolist(), [[] for _ in wanted]
    heaps[0] = [(1e6, -1)] * 6 + [(0.25, -2)]
    bm25.heapq.heapify(heaps[0])
    before = [list(h) for h in heaps]
    held.prepare(np.bincount(np.concatenate(wanted), minlength=60), len(wanted))
    held.improve_all(heaps, wanted, 7, ids, [-1.0] * len(wanted))
    for old, heap, rows in zip(before, heaps, wanted, strict=True):
        total = defaultdict(float)
        for r in rows.tolist():
            for d, g in zip(lists[r].tolist(), gains[r].tolist(), strict=True):
                total[d] += g
        assert sorted(heap) == sorted([(round(s, 9), -ids[d]) for d, s in total.items()] + old)[-7:]


def test_term_counts_are_those_of_the_pattern():
    pattern, rng = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), random.Random(5)
    texts = [None, b"", b" ", bytes(range(256)), "Ünï ÀÉ éa-É\x85b\xa0c\u2003d".encode()]
    texts += [bytes(rng.choices(range(256) if i % 2 else b"aAbZ09 \n\x1c", k=400)) for i in range(40)]
    for text in texts:
        own, count, n = bm25.term_counts(text)
        want = Counter(pattern.findall(text.lower())) if text else Counter()
        hashed = {int(np.uint64(xxhash.xxh3_64_intdigest(w)).astype(np.int64)): c for w, c in want.items()}
        assert dict(zip(own.tolist(), count.tolist(), strict=True)) == hashed and n == sum(want.values())


@pytest.mark.parametrize("few", [0, 100])
def test_a_shard_visits_only_queries_whose_bounds_reach_their_floor(monkeypatch, few):
    texts = ["common " + " ".join(f"w{i}" for i in range(j, j + 20)) for j in range(30)]
    batch = pa.RecordBatch.from_pydict({"id": list(range(30)), "text": texts})
    [shard] = bm25._index(iter([batch]), 10**6)
    own = [bm25.term_counts(t.encode())[0] for t in texts]
    df = Counter(t for ts in own for t in ts.tolist())
    told = bm25.Told(np.repeat(np.arange(100, 130), [len(o) for o in own]), np.concatenate(own), np.array([df[t] for o in own for t in o.tolist()]))
    held = shard.select([n for n in shard.schema.names if n != "level"])

    def found(floors):
        run = bm25._searched(SimpleNamespace(value=told), SimpleNamespace(value=floors), 30, 21.0, 3, few)
        return {q: sorted((-s, d) for x, d, s in rows if x == q) for rows in [[tuple(r.values()) for b in run(iter([held])) for r in b.to_pylist()]] for q in range(100, 130)}

    free = found({})
    assert all(len(x) == 3 and x[0][1] == q - 100 for q, x in free.items())
    visited, cursor, scores = [], bm25._Shard.cursor, bm25.Postings.scores
    monkeypatch.setattr(bm25._Shard, "cursor", lambda self, row, order: visited.append(1) or cursor(self, row, order))
    monkeypatch.setattr(bm25.Postings, "scores", lambda self, wanted: visited.extend([1] * len(wanted)) or scores(self, wanted))
    # Floors that are reached exactly lose nothing.
    assert found({q: -x[2][0] for q, x in free.items()}) == free and visited
    visited.clear()
    assert not any(found(dict.fromkeys(free, 1e4)).values()) and not visited


def test_block_max_wand_is_exact():
    rng = random.Random(8)
    for _ in range(200):
        lists = []
        for _ in range(rng.randint(1, 6)):
            docs = sorted(rng.sample(range(400), rng.randint(1, 300)))
            lists.append((docs, [rng.choice([0.5, 1.0, rng.random()]) for _ in docs]))
        total = defaultdict(float)
        for docs, gains in lists:
            for d, g in zip(docs, gains):
                total[d] += g
        want = sorted(((round(s, 9), d) for d, s in total.items()), key=lambda x: (-x[0], x[1]))[:7]
        assert bm25.block_max_wand(lists, 7) == want


# --- URL filter


def test_url_filter(spark):
    pages = [
        (1, "http://a.example.com/en/7?x#y", ""), (2, "HTTP://B.COM/en/9", ""), (3, None, None), (4, "no url", "x"), (5, "http://x.net/de/80", ""),
        (6, "https://clean.io/p", '<link rel="canonical" href="http://bad.com/en/1">'), (7, "http://clean.io/p/#top", ""),
        (8, "http://ok.io/q", '<LINK href=\'http://example.com/en/70\' rel=canonical>'), (9, "http://bad.com/en/2", '<link rel="canonical" href="//ok.io/q">'),
        (10, "http://r.io/a/b", '<meta http-equiv="refresh" content="0; url=c">'), (11, "http://r.io/a/c?utm_source=z", ""), (12, "http://com/en/", ""), (1, "http://a.example.com/en/7?x#y", ""),
        (13, "http://evilcom/en/", ""),
    ]
    table = spark.createDataFrame([(*p, "old") for p in pages], "page_id long, url string, html string, verdict string")
    redirects = spark.createDataFrame([("http://r.io/a/c", "http://worse.com/en/3")], "src string, dst string")
    got = {r.page_id: r for r in url_filter.judge_urls(table, redirects=redirects).collect()}
    rule = {1: "example.com/en/7", 2: "com/en/", 5: "net/de/", 9: "com/en/", 12: "com/en/"}
    assert {k: r.rule for k, r in got.items() if r.rule} == rule
    assert {k: r.verdict for k, r in got.items()} == {1: "allow", 2: "block", 3: "allow", 4: "allow", 5: "block", 6: "block", 7: "block", 8: "allow", 9: "block", 10: "block", 11: "block", 12: "block", 13: "allow"}
    assert (got[1].host, got[1].path, got[3].host, got[4].path) == ("a.example.com", "/en/7", "", "")
    assert url_filter.judge_urls(table.drop("html")).count() == len(pages)
    assert url_filter.judge_urls(table.limit(0)).count() == 0


def test_registered_url_filter_has_the_verdicts_of_its_contract(spark, tmp_path):
    from graphlake.llm import registry

    contract = "block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/".split(", ")
    urls = [f"http://a.{r.split()[1]}0" for r in contract] + ["http://x.net/de/80", "http://example.net/de/7", "http://x.net/en/1"]
    spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: f"{r.verdict} {r.rule}" for r in registry.op8_url_filter(spark, str(tmp_path)).collect()}
    assert [got[i] for i in range(len(urls))] == [*contract, "allow net/de/", "allow net/de/", "allow None"]


# --- quotation linking


def test_quotes_are_linked_and_removed(spark):
    rows = [
        (1, 0, "user", "Hello there,\nwhat is  a graph?"), (1, 1, "assistant", "> Hello there,\n> What is a graph?\nNodes and edges."),
        (1, 2, "user", ">> hello there,\n>> what is a graph?\n> nodes and edges.\nThanks"), (1, 3, "user", "Unrelated"), (1, 4, "user", "> never said\nhm"),
        (2, 0, "user", "Unrelated"), (2, 1, "user", "> unrelated\nok"), (3, 0, "user", "> nodes and edges.\nfrom elsewhere"), (4, 0, None, None), (None, None, "user", "> unrelated\nx"), (1, 3, "user", "Unrelated"),
    ]
    got = [r for r in quote_linking.link_quotes(spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, thread int")).collect()]
    by = {(r.conv_id, r.turn): r for r in got}
    assert len(got) == len(rows)
    assert (by[1, 1].text, by[1, 1].reply_conv, by[1, 1].reply_turn, by[1, 1].n_quotes, by[1, 1].n_linked) == ("Nodes and edges.", 1, 0, 1, 1)
    assert (by[1, 2].text, by[1, 2].reply_turn, by[1, 2].n_quotes, by[1, 2].n_linked) == ("Thanks", 1, 2, 2)
    assert (by[1, 4].reply_turn, by[1, 4].n_quotes, by[1, 4].n_linked) == (None, 1, 0)
    assert (by[2, 1].reply_conv, by[2, 1].reply_turn, by[3, 0].reply_conv, by[3, 0].reply_turn) == (2, 0, 1, 1)
    assert [by[1, t].thread for t in range(5)] == [0, 0, 0, 3, 4]
    assert by[4, 0].text == ""
    order = [(r.conv_id, r.thread, r.turn) for r in got if r.conv_id is not None]
    assert sorted(order) == sorted(order, key=lambda x: x) and [x for x in order if x[0] == 1] == sorted(x for x in order if x[0] == 1)
    assert quote_linking.link_quotes(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_runs_of_lines_and_nested_quotes_are_linked(spark):
    long = "a one\nb two\n\nc three\nd four\ne five"
    rows = [
        (1, 0, long), (1, 1, "> B two\n> \n> c  three\nyes"), (1, 2, "> c three d four\n> e five\nrewrapped"), (1, 3, "> b two\n> d four\nnot a run"), (1, 4, "> a one\n> x\nno"),
        (2, 0, "first thing\nsecond thing"), (2, 1, "my answer"), (2, 2, ">> first thing\n>> second thing\n> my answer\nand mine"), (2, 3, ">> my answer\n> lost\nhm"),
        (3, 0, "root"), (3, 1, "middle"), (3, 2, "upper"), (3, 3, ">>> root\n>> middle\n> upper\nall"), (3, 4, "alone"), (4, 0, "> d four\n> e five\nelsewhere"), (None, 1, ">> root\n> middle"), (1, 0, long),
    ]
    got = quote_linking.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, text string")).collect()
    assert len(got) == len(rows)
    by = {(r.conv_id, r.turn): (r.reply_conv, r.reply_turn, r.n_quotes, r.n_linked, r.thread) for r in got}
    assert [by[1, t] for t in range(5)] == [(None, None, 0, 0, 0), (1, 0, 1, 1, 0), (1, 0, 1, 1, 0), (None, None, 1, 0, 3), (None, None, 1, 0, 4)]
    assert by[4, 0] == (1, 0, 1, 1, 0)
    assert [by[2, t] for t in range(4)] == [(None, None, 0, 0, 0), (2, 0, 0, 0, 0), (2, 1, 2, 2, 0), (None, None, 2, 1, 0)]
    assert [by[3, t] for t in range(5)] == [(None, None, 0, 0, 0), (3, 0, 0, 0, 0), (3, 1, 0, 0, 0), (3, 2, 3, 3, 0), (None, None, 0, 0, 4)]


def test_wrapped_notices_are_found_and_told_apart(spark):
    cases = [
        ("Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal", "mit"),
        ("# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions are met:", "bsd"),
        (" * Permission to use, copy, modify, and/or distribute this software for any\n * purpose with or without fee is hereby granted, provided", "isc"),
        ("This work is licensed under the GNU General Public License, version 3.", "gpl"),
        ("This work is licensed under the GNU Affero General\nPublic License, version 3.", "agpl"),
        ("redistribute it and/or modify it under the\nterms of the GNU Lesser General Public License", "lgpl"),
        ("Licensed under CC BY-NC 4.0.", "cc-by-nc"), ("x\nLicensed under CC BY-SA 4.0.", "cc-by-sa"), ("Released under the MIT License", "mit"), ("Released under the BSD License", ""),
        ("This work is licensed under a Creative Commons\nAttribution-NonCommercial 4.0 International License", "cc-by-nc"),
        ("This work is licensed under a Creative Commons\nAttribution 4.0 International License", "cc-by-4.0"),
        ("permission free charge granted " + "w " * 30 + "person obtaining copy of this software and associated documentation files to any is hereby", ""), (None, ""), ("", ""),
    ]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan_notices(rows).collect()}
    assert [",".join(m.label for m in got[i].matches) for i in range(len(cases))] == [want for _, want in cases]
    assert [got[i].n_words for i in range(len(cases))] == [len(words(t)) for t, _ in cases]


def mail(seed=4, conversations=30):
    """Conversations whose replies quote lines, paragraphs or all of an earlier message, and what they must be tied to."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows, want = [], {}
    for conv in range(conversations):
        said = []
        for turn in range(rng.randint(2, 7)):
            own = [[" ".join(word() for _ in range(rng.randint(2, 5))) for _ in range(rng.randint(1, 4))] for _ in range(rng.randint(1, 3))]
            quoted, to = [], None
            if turn and rng.random() < 0.8:
                to = rng.randrange(turn)
                flat = [x for p in said[to] for x in p]
                how = rng.randrange(4)
                if how == 0:
                    quoted = [x for p in said[to] for x in [*p, ""]][:-1]
                elif how == 1:
                    quoted = rng.choice(said[to])
                elif how == 2:  # wrapped anew
                    quoted = " ".join(rng.choice(said[to])).split(" ")
                    quoted = [" ".join(quoted[i : i + 3]) for i in range(0, len(quoted), 3)]
                else:
                    lo = rng.randrange(len(flat))
                    quoted = flat[lo : rng.randint(lo, len(flat) - 1) + 1]
            text = "\n".join([f"> {x.upper()}" for x in quoted] + ["\n\n".join("\n".join(p) for p in own)])
            said.append(own)
            rows.append((conv, turn, "user", text))
            want[conv, turn] = (to, bool(quoted), "\n\n".join("\n".join(p) for p in own))
    return rows, want


def test_quotes_of_a_generated_corpus_are_tied_to_what_they_quote(spark):
    rows, want = mail()
    got = quote_linking.link_quotes(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()
    assert len(got) == len(rows) and sum(q for _, q, _ in want.values()) > 40
    threads = {}
    for (conv, turn), (to, _, _) in sorted(want.items()):
        threads[conv, turn] = turn if to is None else threads[conv, to]
    for r in got:
        to, quotes, own = want[r.conv_id, r.turn]
        assert (r.reply_conv, r.reply_turn) == ((r.conv_id, to) if quotes else (None, None)), r
        assert (r.n_quotes, r.n_linked, r.text, r.thread) == (int(quotes), int(quotes), own, threads[r.conv_id, r.turn]), r


def test_a_long_quoting_text_is_parsed_whole(spark):
    lines = [f"line {i} of it" for i in range(20_000)]
    rows = [(1, 0, "\n".join(lines)), (1, 1, "\n".join(f"> {x}\nno" for x in lines[:3_000])), (1, 2, "\n".join("> " + x for x in lines))]
    got = {r.turn: r for r in quote_linking.link_quotes(spark.createDataFrame(rows, "conv_id long, turn int, text string")).collect()}
    assert (got[1].n_quotes, got[1].n_linked, got[1].reply_turn) == (3_000, 3_000, 0) and (got[2].n_quotes, got[2].n_linked, got[2].reply_turn) == (1, 1, 0)


def test_verdicts_over_a_generated_graph_of_redirects(spark):
    rng = random.Random(6)
    urls = [f"http://h{rng.randrange(4)}.{rng.choice(['com', 'net', 'org', 'xyz'])}/{rng.choice(['en', 'de', 'es', 'fr'])}/{i}" for i in range(300)]
    pages = [(i, u, f'<link rel="canonical" href="{rng.choice(urls)}">' if rng.random() < 0.25 else "<p>") for i, u in enumerate(urls)]
    hub = [(u, urls[0]) for u in urls[200:]]
    redirects = [(rng.choice(urls), rng.choice(urls)) for _ in range(40)] + hub
    rules = [("block", "com", "/en/"), ("allow", "h1.com", "/en/"), ("block", "net", "/de/"), ("allow", "org", "/es/")]
    up = {u: u for u in urls}

    def root(u):
        while up[u] != u:
            u = up[u]
        return u

    links = [*redirects, *((u, h.split('"')[3]) for _, u, h in pages if "canonical" in h)]
    for a, b in links:
        up[root(a)] = root(b)

    def rule(u):
        host, path = u[7:].split("/", 1)
        fit = [(len(h + p), action == "allow", action) for action, h, p in rules if (host == h or host.endswith("." + h)) and f"/{path}".startswith(p)]
        return max(fit)[2] if fit else None

    said = defaultdict(set)
    for u in urls:
        said[root(u)].add(rule(u))
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = url_filter.judge_urls(table, rules, spark.createDataFrame(redirects, "src string, dst string")).collect()
    assert len(got) == len(urls)
    for r in got:
        others = said[root(r.url)]
        assert r.verdict == (rule(r.url) or ("allow" if "allow" in others else "block" if "block" in others else "allow")), r


def test_very_long_texts_are_read_to_their_ends(spark):
    rng = random.Random(9)
    long = " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(30_000))
    item = " ".join(f"item{i}" for i in range(12))
    rows = [(1, f"{long}\nAll rights reserved {item}"), (2, f"{long} tail"), (3, "short"), (4, long.upper())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in license_scan.scan_licenses(docs).collect()}
    assert [(p["at"], p["label"]) for p in found[1].places] == [(30_000, "reserved")] and found[2].n_words == 30_001
    hit = {r.doc_id: r for r in decontaminate.scan_contamination(docs, spark.createDataFrame([("x", item)], "item_id string, text string")).collect()}
    assert [sorted(h["at"]) for h in hit[1].hits] == [list(range(30_003, 30_015))] and not hit[2].hits
    groups = {r.doc_id: r.component_id for r in ngram_join.shingle_components(docs).collect()}
    assert groups == {1: 1, 2: 1, 3: 3, 4: 1}
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 5)], "doc_id long, toxic int")
    scores = toxicity.score_toxicity(docs, toxicity.train_classifier(docs, labels)).collect()
    assert len(scores) == 4 and all(0 <= r.score <= 1 for r in scores)
    index = bm25.build_index(docs)
    terms = bm25.key_terms(docs.select(F.col("doc_id").alias("query_id"), "text"), bm25.document_frequencies(index), 4)
    best = {r.query_id: r.doc_id for r in bm25.search(index, terms, k=1).collect()}
    assert best[1] == 1 and best[3] == 3
    page = spark.createDataFrame([(1, "http://a.org/1", "x" * 300_000 + '<link rel="canonical" href="http://b.com/en/1">'), (2, "http://b.com/en/1", "")], "page_id long, url string, html string")
    assert {r.page_id: r.verdict for r in url_filter.judge_urls(page).collect()} == {1: "block", 2: "block"}


# --- language model


def backoff(rows, order, cutoff):
    """Scores by counting with dictionaries."""
    texts = [blank_words(r[1]) for r in rows]
    counts = Counter(tuple(t[i : i + k]) for t in texts for k in range(1, order + 1) for i in range(len(t) - k + 1))
    total = sum(map(len, texts))

    def score(gram):
        if len(gram) == 1:
            return math.log(counts[gram] / total)
        return math.log(counts[gram] / counts[gram[:-1]]) if counts[gram] >= cutoff else math.log(0.4) + score(gram[1:])

    for r, t in zip(rows, texts):
        grams = [tuple(t[max(0, i - order + 1) : i + 1]) for i in range(len(t))]
        yield r[0], len(t), sum(len(g) == order and counts[g] >= cutoff for g in grams), round(sum(map(score, grams)), 5)


@pytest.mark.parametrize("order, cutoff, buckets, chunk", [(2, 2, 1, 2_000_000), (2, 2, 1024, 300), (1, 1, 3, 50), (3, 1, 16, 200), (4, 2, 70_000, 1)])
def test_backoff_scores_match_brute_force(spark, docs, rows, empty, monkeypatch, order, cutoff, buckets, chunk):
    got = backoff_lm.score_documents(docs, order, cutoff, buckets=buckets)
    assert Counter((r.doc_id, r.n_words, r.n_known, round(r.log_score, 5)) for r in got.collect()) == Counter(backoff(rows, order, cutoff))
    assert backoff_lm.score_documents(empty, order, cutoff).count() == 0
    # Chunks of few words, without a session: what a task emits is the same however its texts are cut.
    monkeypatch.setattr(backoff_lm, "CHUNK_WORDS", chunk)
    batch = pa.RecordBatch.from_pydict({"id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())})
    chunks = list(backoff_lm._chunks(iter([batch])))
    bits = (buckets - 1).bit_length()
    asked = pa.Table.from_batches(backoff_lm._asked(order, bits)(chunks)).sort_by([("bucket", "ascending"), ("chunk", "ascending")])
    answers = pa.Table.from_batches(backoff_lm._answered(bits)(iter(asked.to_batches(max_chunksize=5))))
    total = sum(len(blank_words(r[1])) for r in rows)
    score = backoff_lm._scored(order, bits, cutoff, 0.4, total)
    parts = [score(pa.Table.from_batches([c]), answers.filter(pc.equal(answers["chunk"], c["chunk"][0]))) for c in chunks]
    found = [tuple(r.values()) for p in parts for r in p.to_pylist()]
    assert Counter((i, n, k, round(s, 5)) for i, n, k, s in found) == Counter(backoff(rows, order, cutoff))


def test_backoff_counts_a_very_long_text_whole(spark):
    rows = [(1, "a b " * 60_000), (2, "b a c"), (3, None)]
    got = backoff_lm.score_documents(spark.createDataFrame(rows, "doc_id int, text string"))
    assert got.schema["doc_id"].dataType.simpleString() == "int"
    assert Counter((r.doc_id, r.n_words, r.n_known, round(r.log_score, 3)) for r in got.collect()) == Counter((i, n, k, round(s, 3)) for i, n, k, s in backoff(rows, 2, 2))


def test_hash_of_a_line_is_its_text(docs):
    kept = line_dedup.dedup_lines(docs).select("text", F.sha2("text", 256).alias("h")).first()
    assert kept.h == hashlib.sha256(kept.text.encode()).hexdigest()
