"""Every operator against brute force, on texts that hold each awkward case."""

from __future__ import annotations

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.llm import chat, decontaminate, near_copies, packing, pfor, quality, secret_scan, sharding, simhash, substring_dedup, suffix_dedup, token_output
from folioflow.llm.tokens import encoder, tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, key string, salt string, fp string, k_id string, found string, __k_id string, __k_text string, __found string, __lang string, __starts string, parts string, starts string"


def corpus(seed: int = 1, n: int = 60) -> list[tuple[int | None, str | None]]:
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéßÀfg") for _ in range(rng.randint(1, 8))) for _ in range(300)]
    say = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage = say(90)
    docs: list[tuple[int | None, str | None]] = [(i, say(rng.randint(1, 300))) for i in range(n)]
    docs += [(1000, None), (1001, ""), (1002, " \n\t\x0b "), (1003, "one two"), (1004, "be " * 900), (1005, "x" * 3000), (1006, "  \x1c\x85 ſK 🙂 <|endoftext|> İ")]
    docs += [(1010 + i, say(40) + " " + passage + " " + say(40)) for i in range(6)] + [(1020, passage), (1021, passage)]
    docs += [(1030 + i, docs[3][1]) for i in range(4)] + [(1040, docs[4][1] + " zz"), (1041, " ".join(docs[5][1].split()[3:]))]
    docs += [docs[7], docs[7]]  # rows alike in every column
    docs += [(1050, 'password = "hunter22hunter", token: ab token: abcdefgh SECRET=x apikey:sk_12345678'), (1051, "AKIA" + "A1" * 10 + " AKIAB deadbeef" + "0a" * 12), (1052, "key Zx9/Qw3+Lm7=Ty5_Ui1-Op2 end")]
    docs += [(1060, (say(30) + "\n") * 3), (1061, "#*$ " * 60 + say(60)), (1062, "\n".join([say(60)] * 2 + ["  ", "a b", "a b"]))]
    return docs


@pytest.fixture(scope="module")
def docs():
    return corpus()


def frame(spark, docs):
    """With columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, "en", f"src{(i or 0) % 3}", len(t or ""), *["x"] * 13) for i, t in docs], SCHEMA).repartition(3)


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=repr)


def test_token_output(spark, docs, tmp_path):
    path = f"file://{tmp_path}/tokens"
    token_output.write_tokens(frame(spark, docs), path, tokenizer_path(), segment_ids=500)
    found = rows(token_output.read_tokens(spark, path), "doc_id", "start", "n_tokens", "ids_crc32")
    unique = [d for d in docs if docs.count(d) == 1]
    expected = {(r[0], r[2], r[3]) for r in brute.op1([(i, t or "") for i, t in docs], tokenizer_path())}
    assert {(r[0], r[2], r[3]) for r in found} == expected and len(found) == len(docs) and unique
    ordered = sorted(found, key=lambda r: r[1])
    assert [r[0] for r in ordered] == sorted(r[0] for r in found)
    assert all(a[1] + a[2] == b[1] for a, b in zip(ordered, ordered[1:])) and ordered[0][1] == 0


def test_encoder_is_the_tokenizer():
    e, rng = encoder(tokenizer_path()), random.Random(4)
    letters = "aAbB'sStTrRvVlLdDm019.,!<|>_-\"ÀàÉéßÿŸİıſŁłŒœŐőĳŉKÅé́̀\x1c\x7f\x85\xa0 中文🙂ΣςσА\t\n  "
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 30)))
        assert np.frombuffer(e.encode(text.encode()), dtype="<u4").tolist() == brute.token_ids([text], tokenizer_path())[0], text


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 1000, 5001])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    values = (rng.zipf(1.2, n) % (1 << 31)).astype(np.uint32)
    values[: n // 3] = 7
    for percentile in (50, 90, 100):
        data = pfor.encode(values, percentile)
        assert (pfor.decode(data) == values).all()
        assert (pfor.decode(data, n // 3, n // 2) == values[n // 3 : n // 2]).all()
    with pytest.raises(ValueError):
        pfor.decode(b"\x00" * 20)


@pytest.mark.parametrize("hot", [1024, 2])
def test_substring_dedup(spark, docs, hot):
    found = substring_dedup.remove_words(substring_dedup.duplicate_words(frame(spark, docs), hot=hot, heavy_least=1))
    assert rows(found, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.op2(docs), key=repr)


@pytest.mark.parametrize("hot", [1024, 2])
def test_suffix_dedup(spark, docs, hot):
    found = suffix_dedup.remove_bytes(suffix_dedup.duplicate_bytes(frame(spark, docs), hot=hot, heavy_least=1))
    assert rows(found, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(brute.op5(docs), key=repr)


def test_corpus_order_is_suffix_order():
    rng = random.Random(5)
    for _ in range(25):
        base = bytes(rng.choice(b"abc") for _ in range(rng.choice([50, 500, 2000])))
        parts = [base[i : i + rng.randint(1, 900)] + b"ab" * rng.choice([0, 0, 90]) for i in (rng.randrange(len(base)) for _ in range(rng.randint(1, 6)))]
        lengths = np.array([len(x) for x in parts])
        offsets = np.cumsum(lengths) - lengths
        order = suffix_dedup.corpus_order(np.frombuffer(b"".join(parts), dtype=np.uint8), offsets, lengths, every=rng.choice([2, 4, 48]), horizon=10**6)
        suffixes = [x[k:] for x in parts for k in range(len(x))]
        assert [suffixes[i] for i in order] == sorted(suffixes)


@pytest.mark.parametrize("bucket", [2048, 2])
def test_simhash(spark, docs, bucket):
    found = simhash.near_duplicates(frame(spark, docs), bucket=bucket, heavy_least=1).withColumn("fingerprint", F.lower(F.lpad(F.hex("fp"), 16, "0")))
    assert rows(found, "doc_id", "fingerprint", "component_id") == sorted(brute.op3(docs), key=repr)


@pytest.mark.parametrize("bucket", [4, 40, 2048])
def test_links_connect_what_brute_force_links(spark, bucket):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(4)]
    prints = {0}
    for _ in range(300):
        x = rng.choice([*base, *list(prints)[:40]])
        for _ in range(rng.randint(0, 4)):
            x ^= 1 << rng.randrange(64)
        prints.add(x)
    prints = np.array(sorted(prints), dtype=np.uint64)
    signed = prints.view(np.int64).tolist()
    links = simhash.near_links(spark.createDataFrame([(x,) for x in signed], "fp long"), bucket=bucket)
    edges = [(r["a"], r["b"]) for r in links.collect()]
    by = {x: i for i, x in enumerate(signed)}
    parent = list(range(len(signed)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        parent[root(by[a])] = root(by[b])
    expected = brute.components(prints)
    mine = [root(i) for i in range(len(signed))]
    assert len(set(zip(mine, expected))) == len(set(mine)) == len(set(expected))


def test_packing(spark, docs):
    found = packing.pack(packing.cut_pieces(frame(spark, docs), tokenizer_path(), capacity=256), capacity=256, numbered=5).collect()
    expected = sorted((i, k, at, len(ids[at : at + 256]), brute.crc(ids[at : at + 256])) for (i, t), raw in zip(docs, brute.token_ids([t for _, t in docs], tokenizer_path())) for ids in [[*raw, 0]] for k, at in enumerate(range(0, len(ids), 256)))
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == expected
    total = 0
    sequences: dict[int, list] = {}
    for r in found:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        total += r["length"]
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert len(sequences) <= -(-total // 256) * 1.03 + 1


def test_plan_fills_gaps_exactly():
    assert max(s[3] + s[2] for s in packing.plan_sequences({7: 2, 5: 1, 3: 1, 2: 2, 1: 2}, 10)) == 3
    assert packing.plan_sequences({}, 10) == []
    plan = packing.plan_sequences({10: 1000, 4: 10**9, 2: 10**9, 3: 1}, 10)
    assert sum(s[2] * s[0] for s in plan) == 10_000 + 6 * 10**9 + 3 and len(plan) < 30


def test_secret_scan(spark, docs):
    found = secret_scan.scan_secrets(frame(spark, docs), heavy_least=1)
    assert rows(found, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == sorted(brute.op6(docs), key=repr)
    spans = dict(rows(found.select("doc_id", secret_scan.span_text().alias("spans")), "doc_id", "spans"))
    assert "mixed:4:27" in spans[1052] and spans[1001] == ""
    text = dict(rows(secret_scan.redact(frame(spark, docs)), "doc_id", "text"))
    assert text[1052] == "key [SECRET] end" and text[1020] == dict(docs)[1020] and text[1000] is None


SECRETS = "doc_id long, text string, lang string, source string, n_chars long"


def test_ownership_decides(spark):
    """Values by how many owners and repositories carry them, against counts taken here."""
    rng = random.Random(11)
    values = ["".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghjkmnpqrstuvwxyz23456789") for _ in range(28)) for _ in range(12)]
    values = [v for v in values if secret_scan._is_mixed(v)]
    data, carried = [], {v: (set(), set()) for v in values}
    for k, v in enumerate(values):
        for j in range([1, 2, 3, 6, 18, 20][k % 6]):
            source = f"s{j if k % 6 < 4 else 0}"
            data.append((len(data), f"see {v} here", "en", source, 1))
            carried[v][0].add(source)
            carried[v][1].add(len(data) - 1)
    data.append((None, f"again {values[0]}", "en", None, 1))
    carried[values[0]][0].add(None)
    carried[values[0]][1].add(None)
    found = secret_scan.scan_secrets(spark.createDataFrame(data, SECRETS), heavy_least=2)
    spans = rows(found.select("doc_id", secret_scan.span_text(verdict=True).alias("spans")), "doc_id", "spans")
    want = []
    for i, text, *_ in data:
        owners, repositories = carried[text.split()[1]]
        start, live = text.index(text.split()[1]), len(owners) <= secret_scan.LIVE_OWNERS and len(repositories) <= secret_scan.LIVE_REPOSITORIES
        want.append((i, f"mixed:{start}:{start + 28}:{len(owners)}:{len(repositories)}:live" if live else ""))
    assert spans == sorted(want, key=repr)
    assert any(x for _, x in want) and not all(x for _, x in want)
    # Counted out of the corpus, the same strings get the other verdict.
    alone = secret_scan.scan_secrets(spark.createDataFrame([(1, f"see {v} here", "en", "s", 1) for v in values], SECRETS))
    assert all(r["found"][0]["live"] for r in alone.collect())


def test_named_credentials_are_found_where_they_are_only_quoted(spark):
    value, example = "Tr0ub4dor-and-3", "examplekey12345"
    data = [(1, f"token = {value}", "en", "a", 1), (2, f"he wrote {value} down", "en", "a", 1), (3, "other99-string-x", "en", "b", 1)]
    data += [(10 + k, f"api_key: {example}", "en", f"s{k}", 1) for k in range(4)] + [(20, f"use {example} as in the manual", "en", "z", 1)]
    df = spark.createDataFrame(data, SECRETS)
    spans = dict(rows(secret_scan.scan_secrets(df).select("doc_id", secret_scan.span_text().alias("spans")), "doc_id", "spans"))
    assert spans[2] == "bare:9:24" and spans[3] == "" and spans[20] == "" and spans[10].startswith("assign:0:")
    text = dict(rows(secret_scan.redact(df), "doc_id", "text"))
    assert text[1] == "[SECRET]" and text[2] == "he wrote [SECRET] down" and text[10] == f"api_key: {example}" and text[20] == data[-1][1]


def chat_by_hand(turns, segment):
    said = {}
    for conv, turn, role, text in turns:
        said.setdefault(conv, []).append((turn is not None, turn or 0, role or "unknown", text or ""))
    out = []
    for conv, messages in said.items():
        messages.sort()
        for who in {m[2] for m in messages} - {"system"}:
            for k in range(0, len(messages), segment):
                part = [m[2:] for m in messages[k : k + segment]]
                name = lambda s: s if s == "system" else "assistant" if s == who else f"user name={s}"  # noqa: E731, B023
                out.append((conv, who, k // segment, len(part), "".join(f"<|{name(s)}|>{t}<|end|>\n" for s, t in part), "".join("01"[s == who] for s, _ in part), sum(len(t) for s, t in part if s == who)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("segment", [3, 64, 256])
def test_chat_rotation(spark, segment):
    turns = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "yo"), (1, 3, None, None), (2, None, "ann", "a"), (2, 1, "ann", "b"), (2, 1, "ann", "b"), (None, 0, "eve", "e"), (7, 0, "system", "x")]
    turns += [(5, i // 4, "ann" if i % 2 else "bob", f"m{i}") for i in range(700)]  # long, several messages a turn
    turns += [(6, None, "eve", "same")] * 300 + [(8, 4, f"p{i}", "once") for i in range(40)]  # one turn, equal messages; many speakers
    random.Random(1).shuffle(turns)
    schema = "conv_id long, turn long, role string, text string, said string, n string, segment string"
    found = chat.rotate(spark.createDataFrame([(*t, "x", "x", "x") for t in turns], schema).repartition(3), segment=segment)
    assert rows(found, "conv_id", "perspective", "segment", "n_messages", "rendered", "mask", "n_learned_chars") == chat_by_hand(turns, segment)
    if segment == 256:
        whole = {(r["conv_id"], r["perspective"], r["segment"]): r for r in found.collect()}
        assert whole[1, "bob", 0]["rendered"] == "<|system|>be kind<|end|>\n<|user name=ann|>hi<|end|>\n<|assistant|>yo<|end|>\n<|user name=unknown|><|end|>\n"


def test_quality_base_and_outliers(spark, docs):
    found = quality.judge(frame(spark, docs))
    assert rows(found, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == sorted(((i, *brute.op8_base(t)) for i, t in docs), key=repr)
    rng = random.Random(2)
    good = [(i, " ".join("".join(rng.choice("etaoin") for _ in range(rng.randint(2, 8))) for _ in range(120)) + ".", "en", "s", 1) for i in range(300)]
    bad = [(1000 + i, " ".join("".join(rng.choice("ETAOIN") for _ in range(rng.randint(2, 8))) + "$$$" for _ in range(120)), "en", "s", 1) for i in range(30)]
    kept = dict(rows(quality.judge(spark.createDataFrame(good + bad, "doc_id long, text string, lang string, source string, n_chars long")), "doc_id", "kept"))
    assert all(kept[i] for i in range(300)) and not any(kept[1000 + i] for i in range(30))
    left = quality.keep_good(spark.createDataFrame(good + bad, "doc_id long, text string, lang string, source string, n_chars long"))
    assert sorted(r["doc_id"] for r in left.collect()) == list(range(300))


def test_concentration_steps_match_numpy(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate((rng.normal(0, 1, (400, 5)), rng.normal(9, 0.5, (80, 5))))
    names, d = list(quality.FEATURES), 5
    vectors = spark.createDataFrame([("g", *map(float, r)) for r in x], "grp string, " + ", ".join(f"{n} double" for n in names))
    got = quality.robust_estimates(vectors).first()
    floors = np.array(list(quality.FEATURES.values()))
    middle = np.median(x, axis=0)
    mean, precision, last = middle, np.diag(1 / ((1.4826 * np.median(abs(x - middle), axis=0)) ** 2 + floors**2)), np.inf
    while True:
        d2 = np.einsum("ij,jk,ik->i", x - mean, precision, x - mean)
        near = x[d2 <= np.quantile(d2, quality.SHARE)]
        cov = np.cov(near.T, bias=True) + np.diag(floors**2)
        mean, precision, logdet = near.mean(axis=0), np.linalg.inv(cov), np.linalg.slogdet(cov)[1]
        if logdet > last - quality.SETTLED:
            break
        last = logdet
    assert np.allclose([got[f"m_{i}"] for i in range(d)], mean, atol=0.05) and abs(got["m_0"]) < 0.3
    d2 = np.einsum("ij,jk,ik->i", x - mean, precision, x - mean)
    scale = max(1, np.median(d2) / quality.MEDIAN5)
    assert np.allclose([got[f"v_{i}_{j}"] for i in range(d) for j in range(i, d)], (cov * scale)[np.triu_indices(d)], atol=0.1) and got["n"] == 480


def test_decontamination_matches_full_alignment(spark):
    rng = random.Random(3)
    say = lambda k: "".join(rng.choice("abcdefgh ") for _ in range(k))
    items = [(k, say(rng.randint(30, 110))) for k in range(10)] + [(50, None), (51, "  "), (52, "zyxwvutsrq po"), (53, "qqqq"), (54, "Qqqq z")]
    texts = []
    for i in range(60):
        p = list(items[rng.randrange(10)][1])
        for _ in range(rng.randint(0, len(p) // 8)):
            at, o = rng.randrange(len(p)), rng.random()
            p[at : at + 1] = [] if o < 0.3 else [rng.choice("abcdefgh ")] if o < 0.6 else [p[at], rng.choice("abcdefgh ")]
        texts.append((i, say(rng.choice([0, 4, 150])) + "".join(p).upper() + say(rng.choice([0, 4, 150]))))
    texts += [(100, None), (101, ""), (102, say(20000)), (103, "ab  Zyxwvutsrq\nPO cd"), (104, "b qqqq z"), (105, "bqqqq z qqqqz")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.with_matches(frame(spark, texts), bench, name="hits").collect()
    got = {(r["doc_id"], h["item_id"]) for r in found for h in r["hits"]}
    raw = dict(texts)
    spans = {(r["doc_id"], h["item_id"]): (raw[r["doc_id"]][h["start"] : h["stop"]], h["edits"]) for r in found for h in r["hits"]}
    assert {g for g in got if g[0] > 102} == {(103, 52), (104, 53), (104, 54)} and spans[103, 52] == ("Zyxwvutsrq\nPO", 0) and spans[104, 54] == ("qqqq z", 0)
    assert all(decontaminate.normal(t) == decontaminate.normal(dict(items)[i]) for (_, i), (t, e) in spans.items() if not e) and any(not e for _, e in spans.values())
    index = decontaminate.Index(items)
    expected = {(i, item) for i, t in texts[:60] for (item, text), e in zip(index.items, index.edits) if brute.edit_distance_within(text, decontaminate.normal(t)) <= e}
    assert expected <= got and {g for g in got if g[0] < 100} == expected and len(found) == len(texts)
    blocks = list(decontaminate.benchmark_blocks(bench, block_chars=100))
    assert len(blocks) > 3
    again = decontaminate.with_matches(frame(spark, texts), bench, name="hits", block_chars=100).collect()
    assert {(r["doc_id"], h["item_id"]) for r in again for h in r["hits"]} == got
    clash = decontaminate.with_matches(frame(spark, texts), bench)
    assert clash.columns[-1] == "found_" and {r["found"] for r in clash.collect()} == {"x"}
    clean = decontaminate.drop_contaminated(frame(spark, texts), bench)
    assert {r["doc_id"] for r in clean.collect()} == {i for i, _ in texts} - {i for i, _ in got} and clean.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")


def test_sharding(spark, docs, tmp_path):
    df = frame(spark, docs)
    schema = f"bucket bigint, place bigint, record {df.schema.simpleString()}, shard int"
    runs = []
    for k in range(2):
        sharding.write_shards(df, f"file://{tmp_path}/shards{k}", shards=4, bucket_bytes=2000, task_bytes=9000)
        runs.append(sharding.read_shards(spark, f"file://{tmp_path}/shards{k}", schema).collect())
    back = runs[0]
    placed = [sorted(((r["shard"], r["slot"], r["record"]["doc_id"], r["record"]["text"]) for r in x), key=repr) for x in runs]
    assert placed[0] == placed[1]  # the seed, the records and the splits decide
    assert sorted(((r["record"]["doc_id"], r["record"]["text"]) for r in back), key=repr) == sorted(docs, key=repr)
    slots: dict[int, list] = {}
    for r in back:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    # Law: the id and the number of shards decide.
    law = dict(spark.createDataFrame([(i,) for i in {i for i, _ in docs}], "doc_id long").select("doc_id", sharding.shard_of("doc_id", 4)).collect())
    assert all(law[r["record"]["doc_id"]] == r["shard"] for r in back)
    grown = spark.range(5000).select(sharding.shard_of("id", 16).alias("a"), sharding.shard_of("id", 17).alias("b")).collect()
    assert all(r["a"] == r["b"] or r["b"] == 16 for r in grown) and 200 < sum(r["a"] != r["b"] for r in grown) < 400
    counts = [sum(r["a"] == s for r in grown) for s in range(16)]
    assert min(counts) > 240 and max(counts) < 390
    # The order is no order of the input.
    ordered = [r["record"]["doc_id"] or 0 for r in sorted(back, key=lambda r: (r["shard"], r["slot"]))]
    falls = sum(b < a for a, b in zip(ordered, ordered[1:]))
    assert 0.3 < falls / len(ordered) < 0.7


def test_buckets_of_a_repeated_id_stay_small(spark, tmp_path):
    df = spark.createDataFrame([(1 if k < 300 else k, "x" * 99) for k in range(400)], "doc_id long, text string").repartition(4)
    sharding.write_shards(df, f"file://{tmp_path}/s", shards=4, bucket_bytes=1000)
    back = sharding.read_shards(spark, f"file://{tmp_path}/s", f"bucket bigint, place bigint, record {df.schema.simpleString()}, shard int")
    assert back.groupBy("shard", "bucket").count().agg(F.max("count")).first()[0] < 30


def test_shuffle_is_uniform(spark, tmp_path):
    """Where the smallest id of each bucket lands, over some hundred buckets of one write."""
    df = spark.createDataFrame([(k, "") for k in range(1200)], "doc_id long, text string").repartition(2)
    sharding.write_shards(df, f"file://{tmp_path}/u", shards=1, bucket_bytes=8, task_bytes=400)
    buckets: dict[int, list] = {}
    for r in sharding.read_shards(spark, f"file://{tmp_path}/u", f"bucket bigint, place bigint, record {df.schema.simpleString()}, shard int").collect():
        buckets.setdefault(r["bucket"], []).append((r["record"]["doc_id"], r["slot"]))
    share = [(min(x)[1] - min(s for _, s in x)) / (len(x) - 1) for x in buckets.values() if len(x) > 3]
    assert len(share) > 100 and 0.4 < sum(share) / len(share) < 0.6 and 0.0 in share and 1.0 in share


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    token_output.write_tokens(none, f"file://{tmp_path}/t", tokenizer_path())
    assert token_output.read_tokens(spark, f"file://{tmp_path}/t").count() == 0
    assert substring_dedup.remove_words(substring_dedup.duplicate_words(none)).count() == 0
    assert suffix_dedup.remove_bytes(suffix_dedup.duplicate_bytes(none)).count() == 0
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0
    assert packing.pack(packing.cut_pieces(none, tokenizer_path())).count() == 0
    assert secret_scan.scan_secrets(none).count() == 0 and secret_scan.redact(none).count() == 0
    assert quality.judge(none).count() == 0 and quality.keep_good(none).count() == 0
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.with_matches(none, bench).count() == 0
    assert decontaminate.drop_contaminated(frame(spark, [(1, "abc")]), bench).count() == 1
    sharding.write_shards(none, f"file://{tmp_path}/s")
    assert chat.rotate(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_clashing_columns_pass(spark, docs):
    """Operators that return the table's own columns return all of them, whatever they are called."""
    df = frame(spark, docs[:70])
    bench = spark.createDataFrame([(1, docs[2][1] or "")], "item_id long, text string")
    outs = [secret_scan.redact(df), simhash.keep_one(df), quality.keep_good(df), decontaminate.drop_contaminated(df, bench), near_copies.keep_one_similar(df)]
    for out in outs:
        assert out.columns == df.columns and {r["__k_id"] for r in out.collect()} == {"x"}


def test_other_tokenizers_encode_whole_texts():
    path, text = tokenizer_path("byte_bpe_50k.json"), "Hello  World\n it's 12,5 <|endoftext|> é"
    assert np.frombuffer(encoder(path).encode(text.encode()), dtype="<u4").tolist() == brute.token_ids([text], path)[0]


def test_planted_passages(spark):
    """Passages of 50 words and more in unlike documents: those of 400 bytes and more go, shorter ones and clean texts stay."""
    rng = random.Random(12)
    say = lambda k, n=4: " ".join("".join(rng.choice("abcdefghij") for _ in range(n)) for _ in range(k))
    short, exact, long = say(60), say(81)[:400], say(90, 6)
    docs = [(i, f"{say(70)} {p} {say(70)}") for i, p in enumerate([short, short, exact, exact, long, long, long])] + [(20 + i, say(200)) for i in range(5)]
    found = {r["doc_id"]: r for r in suffix_dedup.remove_bytes(suffix_dedup.duplicate_bytes(frame(spark, docs))).drop("kept").collect()}
    assert len(short) < 400 <= len(exact) and [found[i]["n_removed"] for i in (0, 1)] == [0, 0]
    assert all(400 <= found[i]["n_removed"] <= 402 and found[i]["n_spans"] == 1 for i in (2, 3)) and all(found[i]["n_removed"] >= len(long) for i in (4, 5, 6))
    assert all(found[i]["n_removed"] == 0 for i in range(20, 25))
    words = {r["doc_id"]: r["n_removed"] for r in substring_dedup.remove_words(substring_dedup.duplicate_words(frame(spark, docs))).select("doc_id", "n_removed").collect()}
    assert words[0] == words[1] == 60 and all(words[i] == 0 for i in range(20, 25))


def test_factors_are_what_finds_repeats(monkeypatch):
    """Greedy factors against windows counted one by one; without factors, what lies inside them is not found."""
    rng = random.Random(1)
    lost = 0
    for _ in range(150):
        window = rng.choice([3, 5, 8])
        base = [rng.randrange(4) for _ in range(rng.randrange(20, 300))]
        blocks = []
        for _ in range(rng.randrange(1, 12)):
            size = rng.randrange(1, 20) - 1 + window
            at = rng.randrange(max(1, len(base) - size))
            block = base[at : at + size]
            block += [rng.randrange(9) for _ in range(size - len(block))]
            if rng.random() < 0.5:
                block[rng.randrange(size)] = 99
            blocks.append(block)
        symbols = np.array(sum(blocks, []), dtype=np.uint64)
        lengths = np.array([len(b) for b in blocks])
        n, offsets = lengths - window + 1, np.cumsum(lengths) - lengths
        places = substring_dedup.window_places(offsets, n)
        seen = [tuple(symbols[p : p + window].tolist()) for p in places]
        want = [seen.count(w) > 1 for w in seen]
        assert substring_dedup.repeated_windows(symbols, offsets, n, window).tolist() == want
        longest, source = substring_dedup.Reference(symbols, offsets, lengths).longest()
        starts, sizes = substring_dedup.factors(longest, offsets, lengths)
        assert sizes.sum() == len(symbols) and all((symbols[s : s + k] == symbols[source[s] : source[s] + k]).all() for s, k in zip(starts, sizes) if longest[s])
        with monkeypatch.context() as m:
            m.setattr(substring_dedup, "factors", lambda length, offsets, lengths: (offsets[:0], offsets[:0]))
            lost += substring_dedup.repeated_windows(symbols, offsets, n, window).tolist() != want
    assert lost > 50


def test_null_ids(spark):
    some = [(None, "a b c d"), (None, None), (3, "a b c d"), (None, "a b c d")]
    assert [tuple(r) for r in simhash.near_duplicates(frame(spark, some)).select("component_id").distinct().collect()].count((3,)) == 1
    assert simhash.keep_one(frame(spark, some)).count() == 2
    assert substring_dedup.remove_words(substring_dedup.duplicate_words(frame(spark, some))).count() == 4
    assert secret_scan.redact(frame(spark, some)).count() == 4


def test_long_text(spark):
    rng = random.Random(8)
    long = " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(400_000))
    some = [(1, long), (2, long[1_200_000:1_202_000])]
    found = {r["doc_id"]: r for r in suffix_dedup.remove_bytes(suffix_dedup.duplicate_bytes(frame(spark, some))).drop("kept").collect()}
    assert found[1]["n_removed"] == found[2]["n_removed"] == 2000
    words = {r["doc_id"]: r["n_removed"] for r in substring_dedup.remove_words(substring_dedup.duplicate_words(frame(spark, some))).select("doc_id", "n_removed").collect()}
    assert words[1] == words[2] > 300
