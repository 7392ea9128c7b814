"""The pipeline against brute force, stage by stage and as a whole."""

import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
from tests.llm.test_operators import WORDS, brute_fingerprint, brute_targets, components_of
from tidemark.llm import packing


def test_run(spark, sf_dir):
    docs = [r.asDict() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    left = [d for d in docs if d["text"] and any(c.isalpha() for c in d["text"])]
    groups = defaultdict(list)
    for d in left:
        groups[re.sub(r"[\x20\x09-\x0D]", "", d["text"])].append(d)
    left = [min(g, key=lambda d: (-len(d["text"]), d["doc_id"])) for g in groups.values()]
    left.sort(key=lambda d: d["doc_id"])
    prints = [brute_fingerprint(d["text"]) for d in left]
    comp = components_of(len(left), [(i, j) for i in range(len(left)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4])
    first = {}
    for i, c in enumerate(comp):
        first.setdefault(c, i)
    left = {left[i]["doc_id"]: left[i] for i in first.values()}
    sizes, words = Counter(), {k: len(WORDS.findall(d["text"])) for k, d in left.items()}
    for k, d in left.items():
        sizes[d["source"]] += words[k]
    target = brute_targets(sizes)

    rows = [r.asDict() for r in corpus_pipeline.run(spark, sf_dir).collect()]
    copies = Counter(r["doc_id"] for r in rows if r["start"] == 0)
    assert set(copies) <= set(left) and max(copies.values()) <= 2
    taken, largest = Counter(), Counter()
    for k, d in left.items():
        taken[d["source"]] += copies[k] * words[k]
        largest[d["source"]] = max(largest[d["source"]], words[k])
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in sizes)
    coder = packing.encoding(packing.default_vocabulary())
    held, sequences = Counter(), defaultdict(list)
    for r in rows:
        held[r["doc_id"]] += r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for k, n in held.items():
        assert n == copies[k] * (len(coder.encode_to_numpy(left[k]["text"], allowed_special="all")) + 1)
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048


def test_near_stage_keeps_documents_with_null_or_repeated_ids(spark, sf_dir):
    def prose(seed):
        rng = random.Random(seed)
        return " ".join(f"w{rng.randrange(9973)}" for _ in range(400))

    rows = [(None, prose(k)) for k in range(20)]
    rows += [(None, prose(0) + " tail"), (3, prose(1) + " tail"), (7, prose(30)), (7, prose(31)), (7, prose(30) + " tail"), (9, prose(32))]
    prints = [brute_fingerprint(t) for _, t in rows]
    comp = components_of(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4])
    assert len(set(comp)) == 23
    out = corpus_pipeline.near(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf_dir).collect()
    kept = [comp[rows.index((r["doc_id"], r["text"]))] for r in out]
    assert sorted(kept) == sorted(set(comp)) and (3, prose(1) + " tail") in [tuple(r) for r in out]


def test_stages_keep_the_columns_and_take_awkward_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = docs.selectExpr("*", "1 AS copies", "'x' AS `key`", "2.0 AS target", "'y' AS lang_pred", "3 AS fp", "4 AS times", "5 AS k_doc", "6 AS m_key", "7 AS __rank", "8 AS __doc", "9 AS __key", "'z' AS __sha256", "1 AS __copy")
    twice = extra.limit(60).unionAll(extra.limit(60))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name
        out = stage(spark, twice, sf_dir)
        assert out.columns == extra.columns and 0 < out.count() <= 240, name
    assert corpus_pipeline.STAGES[1][1](spark, twice, sf_dir).count() == corpus_pipeline.STAGES[1][1](spark, extra.limit(60), sf_dir).count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), sf_dir).count() == 0
