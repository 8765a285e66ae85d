"""Every operator against plain Python, on rows with nulls, empty, long and repeated texts and clashing columns."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from heddle.llm import bpe, chat, decontaminate, quality, sharding, simhash, substrings, tokenfiles, urlfilter
from heddle.llm.queries import vocabulary
from tests.llm import brute

WORDS = "the of and alpha beta gamma delta café naïve über Zürich 42 x_y don't it's <|endoftext|> | $5 #tag 中文 😀 straße ΣΣ".split()


def sentence(r, n):
    return " ".join(r.choice(WORDS) + r.choice(["", "", "", ",", ".", "!?"]) for _ in range(n))


def texts(seed=1, n=60):
    r = random.Random(seed)
    base = [sentence(r, r.randint(1, 150)) + r.choice(["", "\n", "\n\n"]) + sentence(r, r.randint(0, 60)) for _ in range(n)]
    near = [" ".join(w if r.random() > 0.01 else "changed" for w in t.split(" ")) for t in base[:15]]
    copies = base[:5] * 3
    shared = sentence(r, 70)
    passages = [sentence(r, 20) + " " + shared + " " + sentence(r, 20) for _ in range(6)]
    odd = [None, "", " ", "\n\t \r\n", "a" * 1500, "ab " * 600, "word " * 400, "x", "\x1c\x1f \x85 x", "é" * 300, "line\n" * 90, sentence(r, 4000)]
    return base + near + copies + passages + odd


@pytest.fixture(scope="module")
def docs(spark):
    """doc_id and text with columns whose names the operators use inside."""
    rows = [(k, t, "en" if k % 3 else None, f"s{k % 2}", k, "c", b"z") for k, t in enumerate(texts())]
    schema = "doc_id long, text string, lang string, source string, size long, _text string, _packed binary"
    return spark.createDataFrame(rows, schema).repartition(5).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())


def result(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_sharding(docs, rows):
    got = result(sharding.shard_by_bytes(docs, 7))
    want = brute.shards(rows, 7)
    assert {i: (r["size"], r["text_crc32"], r["shard"], r["slot"]) for i, r in got.items()} == want
    assert {r["law"] for r in got.values()} == {"bytes"} and {r["grown_shard"] for r in got.values()} == {None}


def test_sharding_of_ties_and_nothing(spark):
    same = spark.createDataFrame([(7, "same")] * 40 + [(None, None)] * 8, "doc_id long, text string").repartition(3)
    out = sharding.shard_by_bytes(same, 4).groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.max("slot").alias("m")).collect()
    assert sum(r["n"] for r in out) == 48 and all(r["m"] == r["n"] - 1 for r in out)
    assert max(r["b"] for r in out) - min(r["b"] for r in out) <= 24
    assert sharding.shard_by_bytes(same.limit(0), 4).isEmpty()
    with pytest.raises(ValueError):
        sharding.shard_by_bytes(same, 0)


URLS = [
    None, "", "no scheme", "http://", "https://Example.COM/en/x?q#f", "http://www.example.com/en/", "http://a.www.example.com/en/1",
    "http://example.com", "http://example.com?x=/en/", "http://x.net/es/1", "http://x.net/fr", "http://net/fr/", "http://evil.org/z.net/es/1",
    "ftp://notexample.com/en/", "a://b.com/c://d.net/es/", "http://exam.com:80/", "http://é.net/fr/ü", "http://x.org/" + "y" * 5000, "http://com/",
]


def test_url_rules(spark):
    df = spark.createDataFrame(list(enumerate(URLS)) + [(0, None)], "page_id long, url string").withColumn("host", F.lit("clash"))
    got = urlfilter.filter_urls(df).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == brute.judge(URLS[r["page_id"]], urlfilter.RULES), URLS[r["page_id"]]
    assert urlfilter.filter_urls(df.limit(0)).isEmpty()
    extra = urlfilter.filter_urls(df, globs=[("block", "evil.org/*")], default="allow").where("verdict = 'block' and rule is null")
    assert [r["host"] for r in extra.collect()] == ["evil.org"]


def test_automaton_against_fnmatch():
    import fnmatch

    r = random.Random(5)
    globs = ["".join(r.choice("ab*?") for _ in range(r.randint(0, 9))) for _ in range(60)] + ["a" * 70 + "*", "*" + "b" * 130]
    words = ["".join(r.choice("ab") for _ in range(r.randint(0, 12))) for _ in range(300)] + ["a" * 75, "b" * 140, ""]
    hits = urlfilter.simulate(urlfilter.compile_globs(globs), [w.encode() for w in words])
    assert all(hits[i, j] == fnmatch.fnmatchcase(w, g) for i, w in enumerate(words) for j, g in enumerate(globs))


def test_decontamination(spark, docs, rows):
    r = random.Random(2)
    bodies = [t for _, t in rows if t]
    items = [(k, " ".join((r.choice(bodies)).split()[:14])) for k in range(20)] + [(20, "alpha beta"), (21, None), (22, " ,. "), (23, "alpha beta"), (24, "never said")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute.contamination(rows, items)
    assert sum(w[-1] for w in want) > 20
    assert sorted(tuple(x) for x in decontaminate.contamination(docs, bench).collect()) == sorted(want)
    # Far below its real size a block holds a few items: many passes, the same result.
    assert sorted(tuple(x) for x in decontaminate.contamination(docs, bench, block_bytes=300).collect()) == sorted(want)
    assert decontaminate.contamination(docs, bench.limit(0)).where("contaminated").isEmpty()
    assert decontaminate.contamination(docs.limit(0), bench).isEmpty()


def test_decontamination_cuts(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")], "item_id long, text string")
    rows = [(0, "Keep this. One two, three four five six seven eight nine TEN eleven! And this.", "a"), (1, "one two three four five six seven eight nine ten eleven", "b"), (2, None, "c"), (3, "", "d"), (4, "...", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, k0 string")
    spans = {r["doc_id"]: (r["text"], r["k0"]) for r in decontaminate.decontaminate(df, bench).collect()}
    assert spans == {0: ("Keep this. ! And this.", "a"), 2: (None, "c"), 3: ("", "d"), 4: ("...", "e")}
    assert sorted(r["doc_id"] for r in decontaminate.decontaminate(df, bench, remove="documents").collect()) == [2, 3, 4]


def test_bpe_against_the_library(docs, rows):
    path = vocabulary("byte_bpe_50k.json")
    own, library = bpe.codec(path), Tokenizer.from_file(path)
    got = result(bpe.token_digests(docs, path))
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        raw = np.array(ids, "<u4").tobytes()
        text = library.decode(ids, skip_special_tokens=False)
        assert (got[i]["n_tokens"], got[i]["ids_sha256"]) == (len(ids), hashlib.sha256(raw).hexdigest())
        assert got[i]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest() and own.decode(raw) == text
    encoded = bpe.encode(docs, path)
    assert encoded.columns == [*docs.columns, "ids"]
    back = bpe.decode(encoded.drop("text"), path)
    assert all(r["text"] == dict(rows)[r["doc_id"]] or r["text"] == "" for r in back.select("doc_id", "text").collect())
    assert bpe.token_digests(docs.limit(0), path).isEmpty()


def test_bpe_fuzz():
    path = vocabulary("byte_bpe_50k.json")
    own, library = bpe.codec(path), Tokenizer.from_file(path)
    r = random.Random(9)
    alphabet = ["a", "b", " ", "  ", "\n", "\t", "'s", "'ll", "é", "²", "½", "_", "1", "٣", "<|endoftext|>", "<|", "中", "\xa0", "\u2028", "\x1c", "\x85", "😀", "Σ", "İ", "\u0558", "!!", "\r\n", "aaaa", "0" * 50]
    cases = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(1500)] + ["a" * 3000, "ab" * 700]
    for text, ids in zip(cases, own.encode_batch(cases), strict=True):
        assert library.encode(text, add_special_tokens=False).ids == np.frombuffer(ids, "<u4").tolist(), text


def test_a_vocabulary_that_splits_otherwise_is_refused(tmp_path):
    import json

    with open(vocabulary("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": spec["pre_tokenizer"] | {"add_prefix_space": True}}):
        (tmp_path / "v.json").write_text(json.dumps(spec | change))
        with pytest.raises(ValueError):
            bpe.Codec(str(tmp_path / "v.json"))


def test_forced_boundaries_lie_in_no_token():
    own = bpe.codec(vocabulary("byte_bpe_50k.json"))
    piece = "Straße中文zzqxé".encode()
    fragments = own.cut(piece)
    assert b"".join(fragments) == piece and len(fragments) > 1
    for a, b in zip(fragments, fragments[1:], strict=False):
        assert not any(bytes([a[-1], b[0]]) in t for t in own.bytes_of.values() if t != b"<|endoftext|>")


def test_simhash(docs, rows):
    got = result(simhash.near_duplicates(docs))
    prints = [brute.simhash(t) for _, t in rows]
    want = brute.components([i for i, _ in rows], prints)
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{p:016x}" for (i, _), p in zip(rows, prints, strict=True)}
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert simhash.near_duplicates(docs.limit(0)).isEmpty()


def test_simhash_links_at_every_block_size(spark):
    r = random.Random(11)
    centers = [r.getrandbits(64) for _ in range(12)]
    values = {0, (1 << 64) - 1}
    for c in centers:
        for _ in range(25):
            x = c
            for b in r.sample(range(64), r.randint(0, 6)):
                x ^= 1 << b
            values.add(x)
    values = sorted(values)
    want = brute.components(values, values)
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    frame = spark.createDataFrame([(v,) for v in signed], "_fp long")
    for block in (8192, 5):
        links = simhash.link_fingerprints(frame, block=block).collect()
        parent = {v: v for v in signed}

        def root(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in links:
            parent[root(a)] = root(b)
        groups = {}
        for v, u in zip(signed, values, strict=True):
            groups.setdefault(root(v), set()).add(u)
        wanted = {}
        for u in values:
            wanted.setdefault(want[u], set()).add(u)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_chains_admit_all_close_pairs():
    r = random.Random(12)
    near = np.array([sum(1 << b for b in r.sample(range(64), r.randint(0, 4))) for _ in range(5000)], np.uint64)
    assert simhash.chain_fits(near).all()


def test_repeats(docs, rows):
    got = result(substrings.repeated_bytes(docs))
    want = brute.repeats([t for _, t in rows])
    assert {i: tuple(got[i])[1:] for i, _ in rows} == {i: w for (i, _), w in zip(rows, want, strict=True)}
    assert substrings.repeated_bytes(docs.limit(0)).isEmpty()
    shorter = substrings.remove_repeats(docs)
    assert shorter.columns == docs.columns
    left = result(shorter)
    assert left[rows[0][0]]["text"] is not None and all((left[i]["text"] is None) == (t is None) for i, t in rows)


def test_repeats_with_small_pieces(spark, monkeypatch):
    r = random.Random(21)
    body = "".join(r.choice("abcdefgh ") for _ in range(9000))
    cases = [body, body[300:700] + "Z" * 210, "q" + body[4000:4199], "r" + body[5000:5200], "s" + body[5000:5201] + "t", "Z" * 199, "é" * 260, body[100:350] + body[90:340]]
    cases += ["".join(r.choice("ab") * r.randint(1, 90) for _ in range(40)) for _ in range(5)]
    want = brute.repeats(cases)
    monkeypatch.setattr(substrings, "PIECE", 1 << 10)
    monkeypatch.setattr(substrings, "FLUSH", 1 << 11)
    found = [list(x) for x in _local_ranges(cases)]
    for text, own, w in zip(cases, found, want, strict=True):
        spans = substrings.removed(len(text.encode()), own)
        assert (len(spans), sum(b - a for a, b in spans)) == (w[2], w[1])


def _local_ranges(cases):
    """Ranges by the operator's own steps, without a cluster: sort, compare, cut, compare."""
    import pandas as pd
    import pyarrow as pa
    import zstandard

    def table(batches):
        parts = [b.to_pandas() for b in batches]
        return pd.concat(parts) if parts else pd.DataFrame(columns=[*substrings._FIELDS])

    def compare(frame, want):
        ordered = frame.sort_values(["bucket", "refined"], kind="stable")
        batches = [pa.RecordBatch.from_pandas(ordered.iloc[k : k + 50], preserve_index=False) for k in range(0, len(ordered), 50)]
        return table(substrings._compare(iter(batches), want))

    batch = pa.RecordBatch.from_arrays([pa.array(cases)], ["_text"])
    runs = compare(table(substrings._sort_runs(iter([batch]))), True)
    press = zstandard.ZstdCompressor()
    names = [substrings.name_of(c.encode()) for c in cases]
    wanted = runs[runs.kind == substrings.WANTED]
    lists = [wanted[(wanted.d1 == a) & (wanted.d2 == b)][["low", "high", "bucket"]].drop_duplicates().to_dict("records") for a, b in names]
    asked = pa.RecordBatch.from_arrays(
        [pa.array([a for a, _ in names]), pa.array([b for _, b in names]), pa.array([press.compress(c.encode()) for c in cases]), pa.array(lists)],
        ["d1", "d2", "_packed", "_wanted"],
    )
    blocks = compare(table(substrings._sort_blocks(iter([asked]))), True)
    again = blocks[blocks.kind == substrings.WANTED]
    windows = compare(table(substrings._sort_windows(iter([pa.RecordBatch.from_pandas(again, preserve_index=False)]))), False) if len(again) else again
    out = []
    for a, b in names:
        own = set()
        for frame in (runs, blocks, windows):
            known = frame[(frame.kind == substrings.KNOWN) & (frame.d1 == a) & (frame.d2 == b)]
            own |= set(zip(known.low, known.high, strict=True))
        out.append(own)
    return out


def test_quality_statistics(docs, rows):
    got = result(quality.judge(docs))
    for i, t in rows:
        want = brute.base_statistics(t)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["kept"] and r["base_failed"])
    assert quality.judge(docs.limit(0)).isEmpty()
    assert quality.keep_good(docs).columns == docs.columns


def test_quality_sorting_and_lookups_agree(docs, monkeypatch):
    first = {i: r["n_repeat_words"] for i, r in result(quality.judge(docs)).items()}
    monkeypatch.setattr(quality, "LOOKUPS", 0)
    assert {i: r["n_repeat_words"] for i, r in result(quality.judge(docs)).items()} == first


def plain_mcd(x, floors, seed=1, starts=150):
    """Regularised MCD in numpy, by random subsets and exact halves: (log determinant, squared distances of the reweighted estimate)."""
    r, n = np.random.default_rng(seed), len(x)
    half, target = -(-n // 2), np.diag(floors**2)

    def distances(m, cov):
        return np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(cov), x - m)

    def moments(rows, share):
        return rows.mean(0), np.cov(rows.T, bias=True) * quality.consistency(share) + target

    best = None
    for _ in range(starts):
        m, cov = moments(x[r.choice(n, 6, False)], 0.5)
        for _ in range(60):
            m, cov = moments(x[np.argsort(distances(m, cov), kind="stable")[:half]], 0.5)
        found = np.linalg.slogdet(cov)[1], m, cov
        best = found if best is None or found[0] < best[0] else best
    inside = distances(*best[1:]) <= quality.chi2_quantile(quality.INSIDE, 4)
    return best[0], distances(*moments(x[inside], quality.INSIDE))


def test_quality_outliers_against_an_independent_mcd(spark):
    r = random.Random(31)
    clean = [" ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(r.randint(60, 200))) for _ in range(300)]
    junk = [" ".join("".join(r.choice("abcdefghij") for _ in range(5)) + "$$%%" for _ in range(80)) for _ in range(130)]
    df = spark.createDataFrame([(k, t, "en", "s") for k, t in enumerate(clean + junk)], "doc_id long, text string, lang string, source string")
    got = result(quality.judge(df))
    assert all(got[k]["kept"] for k in range(300)) and not any(got[k]["kept"] for k in range(300, 430))
    stats = quality.statistics(df, keep={"_k": F.col("doc_id")}).select("_k", *quality._vector()).toPandas().sort_values("_k")
    x = stats[["x0", "x1", "x2", "x3"]].to_numpy(float)
    ld, d = plain_mcd(x, np.array(list(quality.FLOORS.values())) * quality.UNIT)
    assert (d <= quality.chi2_quantile(1 - quality.TAIL, 4)).tolist() == [got[k]["kept"] for k in range(430)]
    rows = spark.createDataFrame([("en", "s", *map(int, v)) for v in x], "g1 string, g2 string, x0 long, x1 long, x2 long, x3 long")
    found = quality.mcd(rows, quality._groups(rows), 1).collect()
    assert len(found) == 3 and all(row["ld"] <= ld + 0.1 and row["n"] == 430 for row in found)  # ties of a bin stay together


def test_quality_of_nulls_repeats_and_clashing_columns(spark):
    r = random.Random(32)
    clean = [" ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(r.randint(60, 200))) for _ in range(60)]
    junk = " ".join("ab$$%%" for _ in range(20)) + " " + clean[0]
    rows = [(k % 50, t, None if k % 2 else "en", None, k, "c") for k, t in enumerate(clean)]
    rows += [(7, junk, None, None, 1, "c")] * 3 + [(None, clean[1], "en", "x", 2, "c"), (None, None, None, None, 3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words long, `x0.m` string")
    kept = quality.keep_good(df)
    assert kept.columns == df.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(rows[:60] + rows[63:64], key=str)
    assert quality.keep_good(df.limit(0)).isEmpty()


def test_chi_square():
    assert abs(quality.chi2_quantile(0.75, 4) - 5.38527) < 1e-4 and abs(quality.chi2_cdf(5.38527, 6) - 0.5046) < 1e-3


def test_token_files(spark, docs, rows, tmp_path):
    path = vocabulary("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    got = result(tokenfiles.token_file_digests(docs, path))
    start = 0
    for i, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes())), t
        start += len(ids)
    target = str(tmp_path / "t")
    tokenfiles.write_tokens(docs, path, target)
    some = tokenfiles.read_tokens(spark, target, ["doc_id", "n_tokens"], low=10, high=12)
    assert some.columns == ["doc_id", "n_tokens"] and sorted(r["doc_id"] for r in some.collect()) == [10, 11, 12]
    import pyarrow.parquet as pq

    files = sorted((tmp_path / "t").glob("part-*.parquet"))
    ids = []
    for f in files:
        meta = pq.ParquetFile(f).metadata
        own = [meta.row_group(0).column(k) for k in range(meta.num_columns)]
        tokens = next(c for c in own if c.path_in_schema.startswith("ids"))
        assert "DELTA_BINARY_PACKED" in tokens.encodings and all(c.has_offset_index and c.has_column_index for c in own)
        ids += pq.read_table(f, columns=["doc_id"])["doc_id"].to_pylist()
    assert ids == [i for i, _ in rows]
    assert tokenfiles.token_file_digests(docs.limit(0), path).isEmpty()


def test_word_encoder_fuzz():
    path = vocabulary("word_bpe_49k.json")
    own, library = tokenfiles.word_encoder(path), Tokenizer.from_file(path)
    r = random.Random(10)
    alphabet = ["a", "B", " ", "\n", "'s", "'LL", "é", "É", "²", "_", "1", "٣", "<|endoftext|>", "<|startoftext|>", "<|", "中", "\xa0", "\x1c", "\x1f", "\x85", "😀", "Σ", "İ", "ǅ", "J̌", "\u0301", "ﬁ", "ß", "!!", ">", "”", "ʼn", "\u0558"]
    cases = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 30))) for _ in range(2500)]
    for text, ids in zip(cases, own.encode_batch(cases), strict=True):
        assert library.encode(text, add_special_tokens=False).ids == np.frombuffer(ids, "<u4").tolist(), text


def test_chat_rotation(spark):
    rows = [(1, 0, "system", "S"), (1, 1, "ann", "hi"), (1, 2, "bob", "yo😀"), (1, 3, "ann", None), (2, 0, "system", "only"), (None, 5, None, "x"), (3, 1, "a|b\n", "t"), (3, 1, "a|b\n", "t"), (3, 2, "a<b", "x<|im_end|>y<\\|z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segment", F.lit("clash"))
    out = chat.rotate(df).orderBy("conv_id", "perspective", "position").collect()
    whole = {}
    for r in out:
        text = whole.get((r["conv_id"], r["perspective"]), "")
        assert r["start"] == len(text)
        text += r["segment"]
        assert r["stop"] == len(text)
        whole[r["conv_id"], r["perspective"]] = text
    assert set(whole) == {(1, "ann"), (1, "bob"), (None, "%null"), (3, "a%7Cb%0A"), (3, "a%3Cb")}
    assert whole[1, "bob"] == "<|im_start|>system\nS<|im_end|>\n<|im_start|>user name=ann\nhi<|im_end|>\n<|im_start|>assistant\nyo😀<|im_end|>\n<|im_start|>user name=ann\n<|im_end|>\n"
    assert whole[3, "a%3Cb"].endswith("<|im_start|>assistant\nx<\\|im_end|>y<\\\\|z<|im_end|>\n")
    trained = [whole[1, "ann"][r["loss_start"] : r["loss_stop"]] for r in out if r["trained"] and r["perspective"] == "ann"]
    assert trained == ["hi<|im_end|>", "<|im_end|>"]
    assert chat.rotate(df.limit(0)).isEmpty()


def test_chat_in_stretches(spark, monkeypatch):
    df = spark.createDataFrame([(1, k, "ab"[k % 2], "t" * (k % 7)) for k in range(-50, 300)], "conv_id long, turn long, role string, text string")
    want = sorted(tuple(r) for r in chat.rotate(df).collect())
    monkeypatch.setattr(chat, "STRETCH", 16)
    assert sorted(tuple(r) for r in chat.rotate(df).collect()) == want
