"""Operators on texts against brute force, with nulls, empty and long texts, repeats and extra columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BOTH = "doc_id long, text string, lang string, source string, score double, kept boolean, run long"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def corpus():
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(200)] + ["é", "日本", "x.", "THE", "the"]
    base = [rnd.choice(vocabulary) for _ in range(400)]
    rows = []
    for k in range(40):
        words = list(base[: rnd.choice([3, 20, 120, 400])])
        for _ in range(rnd.choice([0, 1, 1, 3])):
            words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
        rows.append((k, " ".join(words)))
    rows += [(100, None), (101, ""), (102, " \n\t"), (103, "a b"), (104, "A b"), (105, "a" * 900), (106, "ab" * 300)]
    rows += [(107, "one line\none line\n\none line"), (107, "one line\none line\n\none line")]
    rows += [(108, " ".join(base * 12)), (109, "!! ## $ % & | < > *" * 8)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 0.5, True, 1) for i, t in corpus()]
    return spark.createDataFrame(rows, BOTH)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, int(k < 30), int(k % 5 == 0)) for k in range(40)] + [(None, 1, None)],
                                 "doc_id long, quality int, toxic int")


def grouped(df, *columns):
    out = collections.defaultdict(list)
    for r in df.collect():
        out[r.doc_id].append(tuple(r[c] for c in columns))
    return {k: sorted(v) for k, v in out.items()}


def expected(one):
    out = collections.defaultdict(list)
    for i, t in corpus():
        out[i].append(one(t or ""))
    return {k: sorted(v) for k, v in out.items()}


def counts(t):
    words = WORD.findall(t)
    windows = collections.Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    seen, again = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), again, len(covered),
            n < 50 or 100 * len(covered) > 50 * n)


def test_quality_counts_match_brute_force(docs, labels):
    from reviewlens.llm import quality
    got = quality.score_documents(docs, quality.fit(docs, labels))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert grouped(got, *names) == expected(counts)
    assert got.filter("kept and base_failed").count() == 0
    kept = quality.keep_documents(docs, quality.fit(docs, labels))
    assert kept.columns == docs.columns
    assert kept.count() == got.filter("kept").count()


def test_quality_without_labels_rejects_only_by_the_base_rules(docs, labels):
    from reviewlens.llm import quality
    got = quality.score_documents(docs, quality.fit(docs, labels.limit(0)))
    assert got.filter("kept = base_failed").count() == 0


def repeats(rows, width=200):
    raw = [(t or "").encode() for _, t in rows]
    seen = collections.Counter(b[k:k + width] for b in raw for k in range(len(b) - width + 1))
    out = collections.defaultdict(list)
    for (i, _), b in zip(rows, raw):
        spans = []
        for k in range(len(b) - width + 1):
            if seen[b[k:k + width]] > 1:
                if spans and k <= spans[-1][1]:
                    spans[-1][1] = k + width
                else:
                    spans.append([k, k + width])
        gone = sum(b - a for a, b in spans)
        kept, at = b"", 0
        for x, y in spans:
            kept, at = kept + b[at:x], y
        kept += b[at:]
        out[i].append((len(b), gone, len(spans), hashlib.sha256(kept).hexdigest()))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("hot", [20_000, 1])
def test_suffix_dedup_matches_brute_force(docs, monkeypatch, hot):
    from reviewlens.llm import suffix_dedup
    monkeypatch.setattr(suffix_dedup, "HOT", hot)  # 1: every class is counted instead of sorted
    got = suffix_dedup.removed(docs)
    assert grouped(got, "n_bytes", "n_removed", "n_spans", "kept_sha256") == repeats(corpus())


def test_suffix_dedup_cuts_whole_characters(spark):
    from reviewlens.llm import suffix_dedup
    rows = [(1, "x" + "é" * 150 + "1", 9), (2, "y" + "é" * 150 + "2", 9)]
    got = suffix_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string, n_chars long"))
    assert sorted((r.text[0], r.text[-1], r.n_chars == len(r.text)) for r in got.collect()) == [
        ("x", "1", True), ("y", "2", True)]


def test_difference_cover_sort_against_windows():
    from reviewlens.llm import suffix_dedup
    rnd = random.Random(3)
    core = bytes(rnd.randrange(97, 100) for _ in range(500))
    texts, places = [], []
    for _ in range(30):
        a = rnd.randrange(0, 60)
        texts.append(core[a:a + 200 + rnd.randrange(80)] if rnd.random() < 0.7 else bytes(rnd.randrange(256) for _ in range(230)))
        places.append(100 - a if texts[-1] in core else 0)
    flags = suffix_dedup.repeated_windows(texts, np.array(places))
    seen = collections.Counter(t[k:k + 200] for t in texts for k in range(len(t) - 199))
    assert [f.tolist() for f in flags] == [[seen[t[k:k + 200]] > 1 for k in range(len(t) - 199)] for t in texts]


def components(rows, size=4, percent=85):
    sets = []
    for _, t in rows:
        w = WORD.findall(lower(t or ""))
        sets.append(frozenset([tuple(w)] if 0 < len(w) < size else [tuple(w[k:k + size]) for k in range(len(w) - size + 1)]))
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = collections.defaultdict(list)
    for a, (i, _) in enumerate(rows):
        least[find(a)].append(i)
    out = collections.defaultdict(list)
    for a, (i, _) in enumerate(rows):
        out[i].append((len(sets[a]), min(least[find(a)])))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("size,percent", [(4, 85), (5, 80)])
def test_ngram_join_matches_brute_force(docs, size, percent):
    from reviewlens.llm import ngram_join
    got = ngram_join.near_duplicates(docs, size=size, percent=percent)
    assert grouped(got, "n_shingles", "component_id") == components(corpus(), size, percent)


def test_bpe_equals_the_library_and_decodes(docs):
    import public_tokenizers as P
    import tiktoken
    from reviewlens.llm import bpe
    vocab = P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.vocabulary(*vocab).ranks, special_tokens={})
    got = bpe.decode(bpe.encode(docs, *vocab), *vocab)
    assert grouped(got, "ids", "bytes") == expected(
        lambda t: (np.array(library.encode_ordinary(t), "<u4").tobytes(), t.encode()))


def test_units_of_odd_texts_equal_the_library():
    import public_tokenizers as P
    import tiktoken
    from reviewlens.llm import bpe
    vocab = P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.vocabulary(*vocab).ranks, special_tokens={})
    rnd = random.Random(1)
    texts = ["".join(rnd.choice(" \n\tab'sé日! \r1\x1c ") for _ in range(rnd.randrange(50))) for _ in range(1500)]
    ids, bounds = bpe._store(*vocab).tokens(texts)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [library.encode_ordinary(t) for t in texts]


def test_records_round_trip_in_order_and_shuffled(spark, docs):
    import public_tokenizers as P
    from tokenizers import Tokenizer
    from reviewlens.llm import records, shared
    path, folder = P.path("byte_bpe_50k.json"), shared.new_folder(spark, "records-test")
    manifest = records.write_records(docs, path, folder)
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    want = expected(lambda t: np.array(library.encode(t, add_special_tokens=False).ids + [2], "<u4").tobytes())
    read = records.with_starts(records.read_records(manifest, folder), manifest)
    assert {k: [x[0] for x in v] for k, v in grouped(read, "ids").items()} == want
    start = 0
    for r in read.orderBy("start").collect():
        assert r.start == start
        start += len(r.ids) // 4
    mixed = records.read_shuffled(spark, manifest, folder, seed=3)
    assert {k: [x[0] for x in v] for k, v in grouped(mixed, "ids").items()} == want


def test_damaged_records_raise():
    import io
    from reviewlens.llm import records
    good = records.frame(records.payload_of(7, np.arange(5), True))
    doc_id, ids = records.parse(records.unframe(io.BytesIO(good).read))
    assert (doc_id, ids.tolist()) == (7, [0, 1, 2, 3, 4])
    for at in (0, 14, len(good) - 1):
        bad = bytearray(good)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            records.unframe(io.BytesIO(bytes(bad)).read)


def test_language_model_base_scores_and_both_ways_of_scoring(docs):
    from reviewlens.llm import pitman_yor
    model = pitman_yor.fit(docs)
    rows = [(i, WORD.findall(lower(t or "")) + ["\0"]) for i, t in corpus()]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    c = collections.Counter(w for i, words in rows if not held[i] for w in words)
    n, v = sum(c.values()), len(c)
    got = pitman_yor.score_documents(docs, model)
    want = collections.defaultdict(list)
    for i, words in rows:
        want[i].append((held[i], len(words), sum(c[w] > 0 for w in words), n,
                        round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words), 6)))
    names = ("held_out", "n_tokens", "n_known", "train_tokens", "base_score")
    assert {k: [(*x[:4], round(x[4], 6)) for x in v] for k, v in grouped(got, *names).items()} == want
    joined = pitman_yor.score_documents(docs, model, lookup_rows=0)
    a, b = grouped(got, "score"), grouped(joined, "score")
    assert a.keys() == b.keys()
    assert all(abs(x[0] - y[0]) < 1e-6 for k in a for x, y in zip(a[k], b[k]))


def test_seating_keeps_one_to_c_tables():
    from reviewlens.llm.pitman_yor import reseat
    rng = np.random.default_rng(1)
    c = np.array([1, 2, 5, 64, 65, 10_000])
    t = np.ones(6, np.int64)
    for _ in range(200):
        t = reseat(c, t, np.full(6, 0.01), np.full(6, 50.0), rng)
        assert (t >= 1).all() and (t <= c).all()


def test_empty_tables(docs, labels):
    from reviewlens.llm import bpe, langid, ngram_join, pitman_yor, quality, suffix_dedup, toxicity
    import public_tokenizers as P
    none = docs.limit(0)
    vocab = P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN
    for df in (quality.score_documents(none, quality.fit(none, labels)), suffix_dedup.removed(none),
               ngram_join.near_duplicates(none), bpe.encode(none, *vocab),
               toxicity.score_documents(none, toxicity.fit(none, labels)),
               langid.predict(none, langid.fit(none)), pitman_yor.score_documents(none, pitman_yor.fit(none))):
        assert df.count() == 0
