"""Operators that look at one row at a time, against brute force, round trips and held-out rows."""

import hashlib
import random
import re
import shutil
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from prunella.llm import chat, decontaminate, language, mixing, pii, quality, tokens, toxicity
from prunella.llm.common import slices

TEXTS = [
    None, "", "\n", " ", "a\n\na\n", "a b c a b c\n\n", "é é é é é # |<\n\n\n x\n x\n\tx", "One two THREE", "x" * 5000, "w " * 20000,
    "Zürich 東京 x y 'tis we're 123 4a", "<|endoftext|> inside", "tail \t", "***&&& $$$",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", "s1", 0, "x") for k, t in enumerate(TEXTS)] + [(3, "again", None, None, None, None), (None, "no id", "en", None, 1, "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")


def test_the_quality_fit_keeps_few_bytes_an_entry():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(5000)]
    texts = pa.array([" ".join(rng.choices(words, k=300)) for _ in range(2000)])
    tracemalloc.start()
    try:
        quality.fit(texts, np.arange(2000) % 2.0, steps=2)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 30 * texts.nbytes


def test_base_counts_are_brute_force():
    def brute(t):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen, dup = set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)

    got = []
    for _, _, buf, off in slices(pa.array(TEXTS)):
        got += list(zip(*(x.tolist() for x in quality.base_counts(buf, off).values()), strict=True))
    assert got == [brute(t) for t in TEXTS]


def test_quality_learns_and_keeps_columns(spark, docs):
    rng = random.Random(1)
    rows = []
    for k in range(300):
        words = [rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(50)) for _ in range(80)]
        bad = k % 4 == 0
        rows.append((k, " ".join(w + "***" if bad else w for w in words), int(not bad), "c"))
    own = spark.createDataFrame(rows, "doc_id long, text string, quality int, base string")
    model = quality.train(own.select("doc_id", "text"), own.select("doc_id", "quality"))
    got = {r["doc_id"]: r for r in quality.score_quality(own, model).collect()}
    assert all(got[k]["kept"] == (q == 1) for k, _, q, _ in rows)
    kept = quality.kept_documents(own, model)
    assert kept.columns == own.columns and kept.count() == sum(r[2] for r in rows)
    none = quality.train(own.select("doc_id", "text"), own.select("doc_id", F.lit(None).cast("int").alias("quality")))
    assert none is None and quality.score_quality(docs, None).count() == docs.count()
    assert quality.score_quality(docs.limit(0), None).count() == 0


def test_toxicity_finds_unseen_misspellings(spark, docs):
    rng = random.Random(2)
    filler = ["".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randint(2, 8))) for _ in range(900)]
    rows = []
    for k in range(800):
        words = [rng.choice(filler) for _ in range(rng.randint(20, 200))]
        if k % 6 == 0:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["grumblex", "wotznik", "flurpish"]))
        rows.append((k, " ".join(words), int(k % 6 == 0)))
    own = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(own.select("doc_id", "text"), own.select("doc_id", "toxic"), where=~toxicity.held_out())
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(own, model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert sum(got[k] == y for k, _, y in held) >= 0.98 * len(held)
    odd = spark.createDataFrame([(1, " ".join(filler[:30]) + " wotzniks grumblexx")], "doc_id long, text string")
    assert toxicity.score_toxicity(odd, model).first()["predicted"] == 1
    scored = toxicity.score_toxicity(docs, model)
    assert scored.count() == docs.count() and scored.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.train(own.limit(0).select("doc_id", "text"), own.limit(0).select("doc_id", "toxic")) is None


def test_languages_of_held_out_rows(spark, docs):
    own = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language.train(own, where=~language.held_out())
    rows = language.identify(own, model).join(own.select("doc_id", "lang"), "doc_id").where(language.held_out())
    assert rows.where("lang = lang_pred").count() >= 0.95 * rows.count()
    got = {r["doc_id"]: r for r in language.identify(docs.where("doc_id is not null"), model).collect()}
    assert all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 for k in (0, 1, 2, 13))
    assert {r["lang_pred"] for r in language.identify(docs, None).collect()} == {"und"}
    assert language.train(own.limit(0)) is None


def test_chat_round_trip(spark):
    said = "</s>[INST] ok [/INST]\\"
    rows = [
        (1, 0, "system", "s"), (1, 1, "user", said), (1, 2, "assistant", said), (1, 3, "user", None), (1, 4, "assistant", "[x](<y>)"), (1, 5, "user", "bye"),
        (2, 0, "user", "alone"), (3, 0, None, None), (4, 1, "a]b[c", "t"), (4, 0, "assistant", ""), (None, 0, "assistant", "n"), (5, 0, "assistant", "z" * 50_000),
    ]
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, example int")
    examples = chat.format_conversations(turns)
    got = {r["conv_id"]: r for r in chat.digests(examples).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: r[1])
        whole = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in own)
        loss = "".join(t or "" for _, _, r, t in own if r == "assistant")
        d = got[conv]
        assert (d["n_turns"], d["turns_sha256"]) == (len(own), hashlib.sha256(whole.encode()).hexdigest())
        assert (d["loss_chars"], d["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    one = examples.where("conv_id = 1").orderBy("example").collect()
    assert len(one) == 3 and chat.parsed(one[0]["text"])[-1] == ("assistant", said)
    assert [chat.unescaped(e["text"][e["loss_start"] : e["loss_end"]]) for e in one] == [said, "[x](<y>)", ""]
    assert chat.format_conversations(turns.limit(0)).count() == 0


def test_surrogates(spark, docs):
    said = [
        "Mr. John Smith met Mrs Anna Smith; then Mr Smith left. Mail a.b@x.org or A.B@X.ORG, call +1 (017) 555-7713.",
        "card 4111 1111 1111 1111, SSN 123-45-6789, from 10.20.30.40, Господин Иван Петров",
        'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "nothing here, v1.2.3 and 3.14",
    ]
    rows = spark.createDataFrame([(100 + k, t, "z") for k, t in enumerate(said)] + [(200 + k, f"n{k}@mail.example.com", "z") for k in range(300)], "doc_id long, text string, kind string")
    got = {r["doc_id"]: r for r in pii.pseudonymised(rows).collect()}
    new = [got[100 + k]["text"] for k in range(4)]
    assert not re.search("John|Anna|Smith|a.b@x|A.B@X|555-7713", new[0]) and not re.search("4111|123-45|10.20.30.40|Петров", new[1]) and "04dbeb" not in new[2]
    assert new[3] == said[3] and got[103]["n_entities"] == 0
    m = re.match(r"Mr\. (\S+) (\S+) met Mrs (\S+) (\S+); then Mr (\S+) left\. Mail (\S+) or (\S+), call \+1 \(\d{3}\) \d{3}-\d{4}\.$", new[0])
    assert m and m[2] == m[4] == m[5] and m[6] == m[7].lower() and m[7] == m[7].upper() and m[6].endswith(".org")
    male = pii.NAMES["given_m", "latin"].split()
    assert m[1] in male and m[3] in pii.NAMES["given_f", "latin"].split()
    card = re.search(r"card (\d{4} \d{4} \d{4} \d{4})", new[1])[1].replace(" ", "")
    assert card[0] == "4" and sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(card)) % 10 == 0
    assert re.search("Господин [А-Я][а-яё]+ [А-Я][а-яё]+", new[1])
    mails = {got[200 + k]["text"] for k in range(300)}
    assert len(mails) == 300 and not any(re.match(r"n\d+@mail\.example", t) for t in mails)
    assert {r["doc_id"]: r["text"] for r in pii.pseudonymised(docs).where("doc_id != 3").collect()} == {k: t for k, t in enumerate(TEXTS) if k != 3}
    assert pii.pseudonymised(docs.limit(0)).count() == 0


def test_names_beyond_the_lists_stay_distinct(spark):
    rows = spark.createDataFrame([(k, "Mr " + "Q" + "".join(chr(97 + (k // 26**j) % 26) for j in range(3))) for k in range(120)], "doc_id long, text string")
    assert len({r["text"] for r in pii.pseudonymised(rows).collect()}) == 120


def test_mixing(spark, docs):
    own = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("row", F.lit(1))
    sizes = mixing.sized(own)
    src = {r["source"]: r for r in mixing.targets(sizes).collect()}
    total = sum(r["source_size"] for r in src.values())
    assert sum(r["target"] for r in src.values()) == pytest.approx(total)
    assert all(r["target"] <= 3 * r["source_size"] + 1e-6 for r in src.values())
    got = mixing.mixture(own).collect()
    words = Counter()
    for r in got:
        words[r["source"]] += r["n_words"]
    assert all(words[s] == r["quota_words"] for s, r in src.items())
    blocks = {(r["shard"], r["sno"], r["block"]) for r in got}
    by_shard = Counter(s for s, _, _ in blocks)
    assert len({(s, b) for _, s, b in blocks}) == len(blocks), "a block belongs to one shard"
    assert len(by_shard) == 16 and max(by_shard.values()) - min(by_shard.values()) <= 1
    again = mixing.mixture(own).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    mixed = mixing.mixed_documents(own)
    count = mixed.groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(mixing.WORD))).alias("n")).collect()
    assert mixed.columns == own.columns and all(r["n"] == src[r["source"]]["quota_words"] for r in count)
    odd = mixing.mixed_documents(docs).groupBy("doc_id").count().collect()
    assert max(r["count"] for r in odd) <= 6 and mixing.mixed_documents(docs.limit(0)).count() == 0


def test_weights_of_a_small_table(spark):
    rows = [(k, "w " * n, s) for k, (n, s) in enumerate([(100, "a"), (10, "b"), (50, "c"), (40, None)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["source"]: r["target"] for r in mixing.targets(mixing.sized(docs)).collect()}
    # 200 words over weights 1, 2, 3, 1: b stops at 30, the rest shares 170 by 1 : 3 : 1.
    assert got == pytest.approx({"a": 34.0, "b": 30.0, "c": 102.0, None: 34.0})


def test_token_files(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok, out = Tokenizer.from_file(path), f"file://{tmp_path}/tokens"
    tokens.write_tokens(docs, out, path)
    rows = tokens.read_tokens(spark, out).orderBy("start").collect()
    texts = sorted([(k, t) for k, t in enumerate(TEXTS)] + [(3, "again"), (None, "no id")], key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    assert [r["doc_id"] for r in rows] == [k for k, _ in texts]
    start = 0
    for r, (_, t) in zip(rows, texts, strict=True):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r["start"], r["n_tokens"], r["ids"]) == (start, len(ids), ids)
        start += len(ids)
    digest = {r["start"]: r["ids_crc32"] for r in tokens.token_digests(spark, out).collect()}
    assert digest == {r["start"]: zlib.crc32(np.asarray(r["ids"], "<u4")) for r in rows}
    meta = pq.ParquetFile(sorted(tmp_path.glob("tokens/*.parquet"))[0]).metadata.row_group(0)
    columns = {meta.column(j).path_in_schema.split(".")[0]: meta.column(j) for j in range(meta.num_columns)}
    assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings and columns["ids"].has_dictionary_page
    assert all(c.has_offset_index and c.has_column_index for c in columns.values()) and columns["ids"].compression == "ZSTD"
    assert tokens.encoded(docs.limit(0), path).count() == 0


def _rows(texts):
    data = [t.encode() for t in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunks_give_the_ids_of_whole_texts(name, monkeypatch):
    rng = random.Random(3)
    letters = " \n\t'aéß1２²_ -.  　\x1c\x85ſ́漢😀s't"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    texts += ["it's,we'll.'s 's!'s", "<|endoftext|>", "a <|endoftext|> b", " a.b,c" * 300, "word " * 9000, ""]
    monkeypatch.setattr(tokens, "CACHE_CHUNKS", 1 << 14)  # so small that the table starts anew
    coder = tokens.Encoder(public_tokenizers.path(name))
    assert coder.by_chunk == (name == "byte_bpe_50k.json")
    want = [coder.tok.encode(t, add_special_tokens=False).ids for t in texts]
    for _ in range(2):
        for a in range(0, len(texts), 500):
            ids, n = coder.rows(*_rows(texts[a : a + 500]))
            assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == want[a : a + 500]


def test_files_beyond_five_digits_keep_their_order(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    for k, number in enumerate((7, 99999, 100000, 100001)):
        own = spark.createDataFrame([(k, f"text number {k}" * (k + 1))], "doc_id long, text string")
        tokens.write_tokens(own, f"file://{tmp_path}/one", path)
        made = next(f for f in (tmp_path / "one").glob("part-*.parquet") if pq.read_metadata(f).num_rows)
        (tmp_path / "all").mkdir(exist_ok=True)
        made.rename(tmp_path / "all" / f"part-{number:05d}-x.zstd.parquet")
        shutil.rmtree(tmp_path / "one")
    got = tokens.token_digests(spark, f"file://{tmp_path}/all").orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [0, 1, 2, 3]
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1].tolist()]


def brute_hits(text, items):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low))
    w, hit, found = words(text), set(), set()
    for k, item in items:
        v = words(item)
        n = min(13, len(v))
        for a in range(len(v) - n + 1 if n else 0):
            for b in range(len(w) - n + 1):
                if w[b : b + n] == v[a : a + n]:
                    hit |= set(range(b, b + n))
                    found.add(k)
    return len(w), len(hit), sorted(found)


def test_decontamination(spark, docs):
    rng = random.Random(4)
    pick = lambda n: " ".join(rng.choice(["Alpha", "beta", "Über", "x1", "naïve"]) for _ in range(n))
    items = [(k, pick(rng.choice([2, 5, 13, 20, 40]))) for k in range(12)] + [(50, None), (None, "beta"), (51, "..."), (52, "一 二")]
    texts = [pick(30) + "; " + rng.choice(items[:12])[1].upper().replace(" ", "--") + " " + pick(rng.randint(0, 400)) for _ in range(30)] + TEXTS + ["一 二 三"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, items int")
    usable = [(k, t) for k, t in items if k is not None and t is not None]
    got = {r["doc_id"]: r for r in decontaminate.find_contamination(rows, bench).collect()}
    for k, t in enumerate(texts):
        n, h, found = brute_hits(t, usable)
        r = got[k]
        assert (r["n_words"], r["n_hit"], r["items"]) == (n, h, found) and r["contaminated"] == (h > 0 and 20 * h >= n)
        spans = sum(len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t[s["start"] : s["end"]].lower())) for s in r["spans"])
        assert spans == h
    clean = decontaminate.clean_documents(rows, bench)
    assert clean.columns == rows.columns and {r["doc_id"] for r in clean.collect()} == {k for k in got if not got[k]["contaminated"]}
    assert decontaminate.find_contamination(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.find_contamination(docs.limit(0), bench).count() == 0


def test_the_mix_is_written_in_shards_and_shuffled(spark, docs):
    own = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("row", F.lit(1))
    sizes = mixing.sized(own)
    sources = mixing.targets(sizes).cache()
    drawn = mixing.pieces(mixing.passes(mixing.stream(sizes, sources)), mixing.shard_quotas(sources))
    got = mixing.dealt(own, drawn, sources).select("*", F.spark_partition_id().alias("at")).collect()
    assert [r["at"] for r in got] == [r["shard"] for r in got] and len({r["shard"] for r in got}) == 16
    order = [(r["shard"], r["turn"], r["sno"], r["block"], r["pass"], r["start"]) for r in got]
    assert order == sorted(order) and [(s, b) for _, _, s, b, _, _ in order] != sorted((s, b) for _, _, s, b, _, _ in order)
    words = Counter()
    whole, parts = {r["doc_id"]: r["text"] for r in own.collect()}, {}
    for r in got:
        n = len(re.findall(mixing.WORD, r["row"]["text"]))
        assert n == r["n_words"] and r["row"]["n_chars"] == len(r["row"]["text"])
        words[r["sno"]] += n
        parts.setdefault((r["sno"], r["start"], r["pass"]), []).append((r["first_word"], r["row"]["doc_id"], r["row"]["text"]))
    assert words == {r["sno"]: r["quota_words"] for r in sources.collect()}
    joined = [(p[0][1], "".join(t for _, _, t in sorted(p))) for p in parts.values()]
    assert sum(t != whole[d] for d, t in joined) <= len(words) and all(whole[d].startswith(t) for d, t in joined)
    assert any(len(p) > 1 for p in parts.values())
    rows = mixing.sharded_documents(own)
    assert rows.columns == own.columns and sorted((r["doc_id"], r["text"]) for r in rows.collect()) == sorted((r["row"]["doc_id"], r["row"]["text"]) for r in got)
    assert mixing.sharded_documents(docs.limit(0)).count() == 0
    import corpus_pipeline

    whole = mixing.sharded_documents(own, whole=True)
    assert sorted(map(str, corpus_pipeline.mix(spark, own, "").collect())) == sorted(map(str, whole.collect()))


def test_draws_over_many_blocks_follow_the_hypergeometric_law(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SEED", "law")
    seen = {}
    for exact in (0, 1 << 40):
        monkeypatch.setattr(mixing, "EXACT_DRAWS", exact)
        draws = []
        for k in range(60):
            monkeypatch.setattr(mixing, "SEED", f"law-{k}")
            sources = spark.createDataFrame([(1, 300 * 1024), (2, 500 * 1024), (3, 5 * 1024)], "sno long, quota_words long")
            cuts = {r["sno"]: r["cuts"] for r in mixing.shard_quotas(sources, levels=1).collect()}
            assert [cuts[s][-1] for s in (1, 2, 3)] == [300, 500, 5] and sum(c[0] for c in cuts.values()) == 403
            draws.append((cuts[1][0], cuts[3][0]))
        seen[exact] = np.asarray(draws)
    # Of 805 blocks, 403 go left: 300 have a mean of 150.2 and a deviation of 6.9; 5 have 2.5 and 1.1.
    for x in seen.values():
        assert abs(x.mean(0) - [150.2, 2.5]).max() < 4 and 5 < x[:, 0].std() < 9 and 0.8 < x[:, 1].std() < 1.5


def test_a_large_benchmark_is_scanned_in_parts(spark, monkeypatch):
    rng = random.Random(6)
    pick = lambda n: " ".join(rng.choice(["Alpha", "beta", "Über", "x1", "naïve"]) for _ in range(n))
    items = [(k, pick(rng.choice([2, 5, 13, 20, 90]))) for k in range(14)] + [(51, "..."), (51, "...," * 200)]
    texts = [pick(30) + "; " + items[k % 14][1].upper() + " " + items[k * 5 % 14][1] + " " + pick(rng.randint(0, 400)) for k in range(30)] + TEXTS
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(k, t, 1) for k, t in enumerate(texts)]
    rows = spark.createDataFrame(rows + rows[:2] + [(None, texts[3], 1), (0, texts[4], 1)], "doc_id long, text string, k int")
    whole = [decontaminate.find_contamination(rows, bench).collect(), decontaminate.clean_documents(rows, bench).collect()]
    monkeypatch.setattr(decontaminate, "ITEM_CHARS", 150)
    assert len(decontaminate.fetched(bench)) > 5
    parts = [decontaminate.find_contamination(rows, bench).collect(), decontaminate.clean_documents(rows, bench).collect()]
    assert any(r["contaminated"] for r in parts[0]) and not all(r["contaminated"] for r in parts[0])
    assert [sorted(map(str, x)) for x in parts] == [sorted(map(str, x)) for x in whole]
    for r in parts[0]:
        if r["doc_id"] not in (0, None):
            assert (r["n_words"], r["n_hit"], r["items"]) == brute_hits(texts[r["doc_id"]], items)


def test_formats_that_are_used_up_grow_and_scripts_stay(spark):
    texts = ["mail _@-.com now", "ёж@a.ru", " ".join(f"{chr(97 + k)}@b.c" for k in range(26)), "call +12345 or +12346 now", "Dr. Maria Smith, Prof John Brown", None]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] * 2, "doc_id long, text string")
    rows = pii.pseudonymised(docs).collect()
    got = {r["doc_id"]: r["text"] for r in rows}
    assert len(rows) == 12 and len({(r["doc_id"], r["text"]) for r in rows}) == 6 and got[5] is None
    assert got[0].endswith("_@-.com now") and got[0] != texts[0]
    assert re.fullmatch(r"[а-яё]{2}@[a-z]\.ru", got[1])
    mails = got[2].split()
    assert len(set(mails)) == 26 and not set(mails) & set(texts[2].split())
    assert len(set(re.findall(r"\+\d+", got[3]))) == 2 and not re.search("Maria|Smith|John|Brown", got[4])


def test_a_text_of_more_chunks_than_the_table_holds(monkeypatch):
    from prunella.llm import tokens

    path = public_tokenizers.path("byte_bpe_50k.json")
    rng = random.Random(8)
    text = " ".join("".join(rng.choices("abcdefghij é,", k=rng.randint(1, 9))) for _ in range(4000))
    texts = ["short one", text, "", "tail of it"]
    off = np.cumsum([0, *(len(t.encode()) for t in texts)])
    buf = np.frombuffer("".join(texts).encode(), np.uint8)
    whole = [tokens.tokenizer(path).encode(t, add_special_tokens=False).ids for t in texts]
    for size in (1, 8, 512, 1 << 21):  # powers of two, as the table wants
        monkeypatch.setattr(tokens, "CACHE_CHUNKS", size)
        ids, n = tokens.Encoder(path).rows(buf, off)
        assert n.tolist() == [len(x) for x in whole] and ids.tolist() == sum(whole, [])


def test_three_million_different_chunks_in_one_row():
    from prunella.llm import tokens

    path = public_tokenizers.path("byte_bpe_50k.json")
    text = " ".join(np.base_repr(k, 36).lower() for k in range(1_000_000, 4_000_000))
    buf = np.frombuffer(text.encode(), np.uint8)
    ids, n = tokens.Encoder(path).rows(buf, np.asarray([0, len(buf)]))
    assert n.tolist() == [len(ids)]
    vocab = {v: k for k, v in tokens.tokenizer(path).get_vocab(with_added_tokens=False).items()}
    assert sum(len(vocab[i]) for i in ids.tolist()) == len(buf)  # a character of this vocabulary stands for a byte
    cut = text.rindex(" ", 0, 200_000)
    want = tokens.tokenizer(path).encode(text[:cut], add_special_tokens=False).ids
    assert ids[: len(want)].tolist() == want


def test_the_pipelines_mix_has_whole_texts(spark):
    texts = {k: " ".join(f"w{k}x{j}" for j in range(1, 40 + 700 * (k % 5))) for k in range(40)}
    docs = spark.createDataFrame([(k, t, "en", f"s{k % 3}", len(t)) for k, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    rows = mixing.sharded_documents(docs, whole=True)
    assert rows.columns == docs.columns
    words = {s: 0 for s in ("s0", "s1", "s2")}
    short = []
    for r in rows.collect():
        assert texts[r["doc_id"]].startswith(r["text"]) and r["n_chars"] == len(r["text"])
        words[r["source"]] += len(r["text"].split())
        short += [r["source"]] * (r["text"] != texts[r["doc_id"]])
    assert len(short) == len(set(short)) <= 3
    want = {r["source"]: r["quota_words"] for r in mixing.targets(mixing.sized(docs)).collect()}
    assert words == want
    assert mixing.sharded_documents(docs.limit(0), whole=True).count() == 0
