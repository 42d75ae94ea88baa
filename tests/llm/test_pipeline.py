"""The pipeline against a plain version, stage by stage, on planted documents."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from graphlake.llm import toxicity  # noqa: E402
from tests.llm.test_operators import line_key, shingle_groups, words  # noqa: E402


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("bcdfgaeiou") for _ in range(rng.randint(3, 7))) for _ in range(900)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(30)) for i in range(4)]
    shared = text(12)
    rows = []
    for i in range(160):
        body = "\n".join(text(rng.randint(20, 40)) for _ in range(rng.randint(1, 4)))
        if i % 5 == 0:
            body += " you scum " + text(5)
        if i % 4 == 1:
            body = shared + "\n" + body
        if i % 20 == 3:
            body += "\n" + text(4) + " " + " ".join(items[i % 4][1].split()[5:20])
        rows.append([i, body])
    for i in range(160, 180):  # exact and near copies
        body = rows[i - 159][1]
        rows.append([i, body if i % 2 else body + " " + text(2)])
    rows += [[180, None], [181, ""], [182, "x"], [183, text(9000)], [184, rows[7][1]], [184, rows[7][1]]]
    docs = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in rows]
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    labels = [(i, 1, int("scum" in (t or ""))) for i, t in rows if i < 160]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, docs, items, labels


def test_stages_match_a_plain_version(spark, tables):
    folder, docs, items, labels = tables
    kept = [(d[0], d[1]) for d in docs]
    chosen = {i: y for i, _, y in labels if zlib.crc32(str(i).encode()) % 3 != 1}
    rows = sorted((i, t, chosen[i]) for i, t in kept if i in chosen)
    sets = [toxicity.features(t) for _, t, _ in rows]
    pairs = [(s, toxicity.features(o)) for s, (_, t, _) in zip(sets, rows) if (o := toxicity.swapped(t))]
    model = toxicity.fit(sets, np.array([y for *_, y in rows]), pairs)
    kept = [(i, t) for i, t in kept if model.score(t) < 0.7]
    want = [Counter(kept)]
    assert not any("scum" in (t or "") for _, t in kept) and len(kept) >= 145
    holders: dict[str, set] = {}
    for d in kept:
        for line in (d[1] or "").split("\n"):
            holders.setdefault(line_key(line), set()).add((d[0], d[1] or ""))
    bad = {k for k, v in holders.items() if k and len(v) >= 10}
    assert bad
    kept = [(i, "\n".join(x for x in (t or "").split("\n") if line_key(x) not in bad)) for i, t in kept]
    want.append(Counter(kept))
    groups = shingle_groups([(i, t) for i, t in kept])
    kept = [d for d in dict.fromkeys(kept) if not groups[d][0] or groups[d][1] == d[0]]
    want.append(Counter(kept))
    assert len(kept) < sum(want[1].values())
    grams = {tuple(w[j : j + 8]) for _, t in items for w in [words(t)] for j in range(len(w) - 7)}
    kept = [(i, t) for i, t in kept if not any(tuple(w[j : j + 8]) in grams for w in [words(t)] for j in range(len(w) - 7))]
    assert len(kept) < sum(want[2].values())
    want.append(Counter(kept))
    now = spark.read.parquet(f"{folder}/documents.parquet")
    columns = now.columns
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        now = corpus_pipeline.materialize(stage(spark, now, folder), name)
        assert now.columns == columns
        assert Counter((r.doc_id, r.text) for r in now.collect()) == want[n], name
    assert all(r.n_chars == len(r.text) for r in now.collect())
    packed = corpus_pipeline.run(spark, folder).collect()
    tokens: Counter = Counter()
    for r in packed:
        tokens[r.doc_id] += r.length
    assert set(tokens) == {i for i, _ in kept}
    assert all(tokens[r.doc_id] % r.doc_tokens == 0 for r in packed)


def test_stages_are_five_and_run_on_empty_documents(spark, tables):
    folder = tables[0]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_copies", "decontamination", "packing"]
    none = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0
