"""The pipeline's stages on odd rows, at their ends and against brute force."""

import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from contourlake.llm import decontamination, packing, quality_rules, simhash

BENCH = "Quite another sentence, about the pitch of voices at sea, and of the wind."


def documents():
    """Good prose with function words, copies and near copies, common lines, leaks with edits, and rows that the quality rules reject."""
    rng = random.Random(12)
    word = lambda: rng.choice(["the", "of", "and", "in"]) if rng.random() < 0.3 else "".join(rng.choices("abcdefghij", k=rng.randrange(3, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    texts = [prose(rng.randrange(60, 400)) for _ in range(40)]
    for base in texts[:8]:
        w = base.split()
        texts += [base, " ".join(w[:-1] + ["edited"]), " ".join([*w[: len(w) // 2], word(), *w[len(w) // 2 + 1 :]])]
    texts += [prose(70) + "\n Common  LINE of\tmany \n" + prose(30) for _ in range(12)]
    texts += [prose(60) + " " + BENCH.upper() + " " + prose(20), prose(60) + " " + BENCH.replace("voices", "vioces") + " " + prose(20), prose(80) + " about the pitch of voices " + prose(20)]
    texts += [prose(20), " ".join(["the same of"] * 60), prose(60).replace(" ", " # % $ "), "\n".join("- " + prose(6) for _ in range(20)), " ".join("q" * 20 for _ in range(60)), "", None, "\n" * 50, "12345 " * 70]
    texts += ["\n".join(prose(9) + "..." for _ in range(12)), "\n".join(["the line of all and"] * 9 + [prose(9) for _ in range(9)]), prose(3000)]
    rows = [(i * 7 % 211, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return rows + [rows[3], (None, texts[5] + " tail of it", "en", "s", 1)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(documents(), "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, BENCH), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def good(t):
    t = t or ""
    w = [x.decode() for x in t.encode().split()]
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    cover = {j for i, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if grams[g] > 1 for j in (i, i + 1, i + 2)}
    if len(w) < 50 or 100 * len(cover) > 50 * len(w):
        return False
    lines = [x for x in t.split("\n") if x.encode().split()]
    chars, stops = sum(map(len, w)), {v for s in quality_rules.STOP_WORDS for v in (s, s.capitalize())}
    return (
        2 <= chars / len(w) <= 14
        and len(re.findall(r"[#*$%&|<>]", t)) / len(w) <= 0.25
        and len(re.findall("[0-9]", t)) / chars <= 0.35
        and len({*w} & stops) >= 2
        and (len(lines) - len({*lines})) / len(lines) <= 0.5
        and sum(x.lstrip(" ")[:1] in ("-", "*", "•") for x in lines) / len(lines) <= 0.9
        and sum(x.rstrip(" ").endswith(("...", "…")) for x in lines) / len(lines) <= 0.3
    )


def without_lines(rows):
    key = lambda x: x.strip(" \t\n\r\x0b\x0c").lower()
    often = Counter(k for k, _ in {(key(x), r[0]) for r in rows for x in (r[1] or "").split("\n")} if k)
    return [(r[0], None if r[1] is None else "\n".join(x for x in r[1].split("\n") if often[key(x)] < 10), *r[2:]) for r in rows]


def representatives(rows):
    def bits(t):
        w = (t or "").lower().split()
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 5]), 42) for i in range(max(1, len(w) - 4))]
        out = 0
        for k in range(8):
            words = [int(simhash.mixed(np.array([x], np.uint64), k)[0]) for x in h]
            out = out << 64 | sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in words) > len(words))
        return out

    f = [bits(r[1]) for r in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (f[i] ^ f[j]).bit_count() <= 77:
                a, b = root[i], root[j]
                root = [b if x == a else x for x in root]
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[root[i]].append(r)
    first = lambda r: (r[0] is not None, r[0] or 0, np.uint64(xxhash.xxh64_intdigest((r[1] or "").encode(), 42)).astype(np.int64).item())
    return [min(v, key=first) for v in groups.values()]


def edits(item, t):
    row = [0] * (len(t) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def clean(rows):
    item = decontamination.normal(BENCH)
    return [r for r in rows if r[1] is None or edits(item, decontamination.normal(r[1])) > decontamination.budget(len(item))]


def test_against_brute_force(spark, folder):
    rows = documents()
    assert len(rows) > 80
    brute = [lambda rows: [r for r in rows if good(r[1])], without_lines, representatives, clean]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    for (name, stage), same in zip(corpus_pipeline.STAGES, brute, strict=False):
        before, rows = rows, same(rows)
        docs = stage(spark, docs, folder)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.columns == names and Counter(map(tuple, docs.collect())) == Counter(rows), name
        assert Counter(before) != Counter(rows), name
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    largest, want = max(packing.CAPACITIES), Counter()
    for r in rows:
        ids = [*model.encode(r[1] or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), largest):
            want[(r[0], tuple(ids[k : k + largest]))] += 1
    for bins in (corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect(), corpus_pipeline.run(spark, folder).collect()):
        have = Counter()
        for b in bins:
            assert len(b["ids"]) <= b["bin_capacity"] in packing.CAPACITIES
            for i, lo, hi in zip(b["doc_ids"], b["offsets"], [*b["offsets"][1:], len(b["ids"])], strict=True):
                have[(i, tuple(b["ids"][lo:hi]))] += 1
        assert have == want


def test_odd_rows(spark, docs, folder):
    """Nulls, ties, repeated rows and columns with names that the operators use."""
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = stage(spark, docs, folder)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.columns == names and 0 < docs.count() <= before, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() > 0


def test_empty(spark, empty, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_duplicates", "leaks", "packed"]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0


def test_leaks_leave_clean_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    kept = {r["doc_id"] for r in decontamination.drop_leaks(docs, bench).collect()}
    items = [decontamination.normal(r["text"]) for r in bench.collect()]
    for r in docs.collect():
        assert (r["doc_id"] not in kept) == any(i in decontamination.normal(r["text"]) for i in items)
