"""The training-data operators against plain versions, round trips and hard inputs."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarry.llm import components, elias_fano, hnsw, langid, mixing, neardup, ngram_lm, packing, secrets, sharding, url_filter, vectors, webp

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def hard(spark):
    """Nulls, empty texts, a long text, ties, repeated rows, and extra columns whose names clash with the operators' own."""
    rows = [
        (1, None, "en", "a", None), (2, "", None, None, 0), (3, "   ", "en", "a", 3), (4, "one two three", "en", None, 13), (4, "one two three", "en", None, 13),
        (5, "word " * 30000, "en", "b", 150000), (None, "no id here at all my friend", "en", "b", 5), (6, 'password = "hunter2hunter"', "de", "b", 9), (7, "1 2 3 !!", "en", "c", 8), (8, "one two three", "fr", "c", 13),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit("x") for c in ("size", "salt", "key", "copies", "label")})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_sharding_law(spark, hard, none):
    rows = sharding.slot_rows(hard)
    got = sharding.assign(rows, sharding.plan(sharding.slot_bytes(rows), 4)).collect()
    assert len(got) == 10
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    rows = sharding.slot_rows(none)
    assert sharding.assign(rows, sharding.plan(sharding.slot_bytes(rows), 4)).count() == 0


def test_shards_are_even_and_rebalance_moves_little(spark, tmp_path):
    rows = sharding.slot_rows(spark.read.parquet(f"{SF}/documents.parquet"))
    stats = sharding.slot_bytes(rows)
    old = sharding.plan(stats, 8)
    size = [r["b"] for r in stats.join(old, "vslot").groupBy("shard").agg(F.sum("bytes").alias("b")).collect()]
    assert max(size) - min(size) <= stats.agg(F.max("bytes")).first()[0]
    new = sharding.rebalance(old, stats, 9)
    both = old.select("vslot", F.col("shard").alias("a")).join(new.select("vslot", F.col("shard").alias("b")), "vslot").collect()
    assert len(both) == old.count() and {r["b"] for r in both} == set(range(9))
    assert sum(r["a"] != r["b"] for r in both) < 0.4 * len(both)
    sharding.save_map(old, f"{tmp_path}/map")
    sharding.save_map(new, f"{tmp_path}/map")
    assert sharding.load_map(spark, f"{tmp_path}/map").count() == len(both)
    assert {r["version"] for r in sharding.load_map(spark, f"{tmp_path}/map").collect()} == {2}
    assert sorted(map(tuple, sharding.load_map(spark, f"{tmp_path}/map", 1).collect())) == sorted(map(tuple, old.collect()))


def test_sharding_equals_a_plain_version(spark):
    """Slots dealt largest first to the emptiest shard, and places by slot, id, crc and size, on collected rows."""
    rows = [r.asDict() for r in sharding.slot_rows(spark.read.parquet(f"{SF}/documents.parquet")).collect()]
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert all(r["size"] == len(texts[r["doc_id"]]) + 16 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]]) for r in rows)
    weight, shard, loads = Counter(), {}, [0] * 40
    for r in rows:
        weight[r["vslot"]] += r["size"]
    for v, n in sorted(weight.items(), key=lambda x: (-x[1], x[0])):
        shard[v] = loads.index(min(loads))
        loads[shard[v]] += n
    want, place = {}, Counter()
    for r in sorted(rows, key=lambda r: (r["vslot"], r["doc_id"], r["text_crc32"], r["size"])):
        want[r["doc_id"]] = (shard[r["vslot"]], place[shard[r["vslot"]]])
        place[shard[r["vslot"]]] += 1
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.op7(spark, SF).collect()} == want


def test_a_hot_id_spreads_over_slots_and_a_version_is_stored_once(spark, tmp_path):
    rows = sharding.slot_rows(spark.createDataFrame([(7, f"text {i}") for i in range(200)], "doc_id long, text string"))
    assert rows.select("vslot").distinct().count() > 150
    first = sharding.plan(sharding.slot_bytes(rows), 4)
    assert sharding.save_map(first, f"{tmp_path}/m") == sharding.save_map(first, f"{tmp_path}/m") == 1
    assert sharding.load_map(spark, f"{tmp_path}/m").count() == first.count()
    got = sharding.assign(rows, sharding.load_map(spark, f"{tmp_path}/m")).collect()
    assert len(got) == 200


def test_mixing(spark, hard, none):
    d = mixing.copies(hard).collect()
    n, target, whole, size = (hard.columns.__len__() + i for i in (3, 2, 1, 0))
    assert len(d) == 10 and all(0 <= r[n] <= 2 for r in d)
    want = 1.5 * sum(r[size] for r in d)
    assert math.isclose(sum({r["source"]: r[target] for r in d}.values()), want)
    assert all(r[target] <= 2 * r[whole] + 1e-9 for r in d)
    assert mixing.mix(hard).columns == hard.columns
    assert sorted(map(str, mixing.mix(hard).collect())) == sorted(map(str, mixing.mix(hard).collect()))
    assert mixing.copies(none).count() == 0


def test_mixing_error_is_at_most_one_document(spark):
    d = mixing.op6(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source"), "doc_id")
    for r in d.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"), F.max("size").alias("m")).collect():
        assert abs(r["t"] - r["g"]) <= r["m"]


def test_packing(spark, hard, none):
    rows = packing.best_fit(hard).collect()
    by, tokens = defaultdict(list), Counter()
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
        tokens[r["doc_id"]] += r["length"]
    for v in by.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 1024
    assert tokens[1] == 1 and tokens[2] == 1
    assert packing.best_fit(none).count() == 0


def test_packing_plan_holds_all_and_wastes_little():
    rng = np.random.default_rng(3)
    counts = {int(n): int(rng.integers(1, 60)) for n in rng.choice(np.arange(1, 1025), 400, replace=False)}
    plan = packing.plan(counts)
    room, placed = Counter(), Counter()
    for length, rank, n, first, offset in plan:
        assert placed[length] == rank
        placed[length] += n
        for s in range(first, first + n):
            assert room[s] == offset
            room[s] += length
    assert placed == Counter(counts) and max(room.values()) <= 1024
    assert len(room) <= 1.02 * sum(k * n for k, n in counts.items()) / 1024 + 1


def test_encoder_equals_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole, encode = Tokenizer.from_file(path), packing.Encoder(path)
    for t in ["", " ", "a  b\n\n c's they'll", "é\xa0\x85x", "漢字 \u3000 12³", "x<|endoftext|>y", "\x1c \x1d\t", "œuvre d'été 99½", " " * 300_000 + "x", "\n" * 3000 + " ÿ", "ab" * 50_000, "...'s 'S  \t x"]:
        assert encode(t) == np.asarray(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_secrets():
    text = 'k = "Zx81kLmnQ9pR2s7t"\napi = k\ndb_password = api\nexport AWS_SECRET_ACCESS_KEY=wJalrXUtnFEMIK7MDENG\npassword = "changeme"\ntoken_count = "1234567890"\nx = "nothing here"\n'
    got = {(s.kind, text[s.start : s.end]) for s in secrets.find(text)}
    assert ("literal", "Zx81kLmnQ9pR2s7t") in got and ("literal", "wJalrXUtnFEMIK7MDENG") in got
    assert not any(k == "literal" and v in ("changeme", "1234567890", "nothing here") for k, v in got)
    assert [s.kind for s in secrets.base("AKIA" + "A" * 16 + " " + "0a" * 12 + ' Secret: "abcdef"')] == ["access", "hex", "assign"]
    assert secrets.base("secret: abc") == [] and secrets.find("") == []
    assert secrets.redact('token = "abcdef123456"') == 'token = "<secret>"'


def _plain_base(text):
    """The base's spans by walking letter by letter, without patterns."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words, value = ("password", "passwd", "secret", "token", "api_key", "apikey"), set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    out = []

    def assign(i):
        for w in words:
            if low.startswith(w, i):
                j = i + len(w)
                j += text[j : j + 1] in ("'", '"')
                while text[j : j + 1] == " ":
                    j += 1
                if text[j : j + 1] not in (":", "="):
                    continue
                j += 1
                while text[j : j + 1] == " ":
                    j += 1
                j += text[j : j + 1] in ("'", '"')
                k = j
                while k < len(text) and text[k] in value:
                    k += 1
                if k > j:
                    return k, k - j >= 6
        return None

    def run(i, head, letters, least):
        if not text.startswith(head, i):
            return None
        k = i + len(head)
        while k < len(text) and text[k] in letters:
            k += 1
        return (k, k - i >= least) if k > i + len(head) else None

    upper, hexes = set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), set("0123456789abcdef")
    for kind, f in (("assign", assign), ("access", lambda i: run(i, "AKIA", upper, 20)), ("hex", lambda i: run(i, "", hexes, 24))):
        i = 0
        while i < len(text):
            hit = f(i)
            if hit and hit[1]:
                out.append((kind, i, hit[0]))
            i = hit[0] if hit else i + 1
    return sorted(out, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


def test_base_spans_equal_a_plain_scan(spark):
    pieces = ["password", "Passwd", "SECRET", "token", "api_key", "apikey", "api", "key", "=", ":", " ", "  ", "'", '"', "abc", "abcdef12", "AKIA", "AKIA" + "Z9" * 9, "0123456789abcdef" * 2, "f" * 23, "\n", "é", "K", "==", "x"]
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(pieces, rng.integers(1, 30))) for _ in range(3000)]
    texts += [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    for t in texts:
        assert [(s.kind, s.start, s.end) for s in secrets.base(t)] == _plain_base(t), t
    assert sum(len(secrets.base(t)) for t in texts) > 300
    for r in secrets.op9(spark, SF).collect()[:50]:
        assert all(x in r["spans"] for x in r["spans"].split(",") if x)


def test_constants_flow_as_by_a_fixpoint():
    rng = np.random.default_rng(5)
    for _ in range(300):
        names = [f"v{i}" for i in range(8)] + ["db_password", "token"]
        found = [secrets.Pair(str(rng.choice(names)), ((i, i + 1),) if rng.random() < 0.5 else (), tuple(map(str, rng.choice(names, rng.integers(0, 3))))) for i in range(12)]
        known = {p.name: set(p.literals) for p in found}
        for p in found:
            known[p.name] |= set(p.literals)
        for _ in range(20):
            for p in found:
                for r in p.refs:
                    known[p.name] |= known.get(r, set())
        best = {}
        for n, spans in known.items():
            for x in spans:
                best[x] = max(best.get(x, -9), secrets.name_score(n))
        got = secrets.reached(found, secrets.name_score)
        for p in found:
            for x in p.literals:
                assert max(got[q.name] for q in found if x in q.literals) == best[x]


def test_names_of_any_length_and_long_chains():
    import time

    for n in (10, 245, 275, 5000):
        assert secrets.literals("my_secret_value" + "_b" * n + ' = "Zx81kLmnQ9pR2s7t"') and secrets.literals('{"my_secret_value' + "_b" * n + '": "Zx81kLmnQ9pR2s7t"}')
        assert secrets.literals('cfg["my_secret_value' + "_b" * n + '"] = "Zx81kLmnQ9pR2s7t"')
    began = time.time()
    chain = 'v0 = "Zx81kLmnQ9pR2s7t"\n' + "".join(f"v{i + 1} = v{i}\n" for i in range(20_000)) + "password = v20000\n"
    assert secrets.literals(chain) == {(6, 22)}
    secrets.find("(" + "a" * 300_000)
    secrets.find("a = b " * 100_000)
    assert time.time() - began < 20
    assert secrets.literals('db_passphrase = "correct horse battery staple 77"')


def test_redacting_null(spark, hard):
    assert [r[0] for r in hard.where("text is null").select(secrets.redacted(F.col("text"))).collect()] == [None]


def test_secrets_on_hard_rows(hard, none):
    rows = secrets.scan(hard).collect()
    assert len(rows) == 10 and sum(r["n_assign"] for r in rows) == 1
    assert secrets.scan(none).count() == 0


def test_language(spark, hard, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs.where("doc_id % 2 = 0"))
    rows = langid.identify(docs.where("doc_id % 2 = 1"), model).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) > 0.97 * len(rows)
    rows = langid.identify(hard, model).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in rows if r["doc_id"] in (1, 2, 3, 7)} == {1: "und", 2: "und", 3: "und", 7: "und"}
    assert langid.identify(none, model).count() == 0 and langid.identify(hard, langid.fit(none)).where("lang_pred <> 'und'").count() == 0
    assert langid.keep_clear(docs).count() == docs.count()


@pytest.mark.parametrize("text", ['5² ½', "Ⅷ ¾ ①", "12_3 !"])
def test_no_letter_no_language(text):
    label = langid.Labeller(langid.Model(["a", "b"], [frozenset(["latin"])] * 2, {"x": np.zeros(2, np.float32)}, np.zeros(2, np.float32)))
    assert label(text) == ("und", 0.0, 0) and label.spans(text) == []
    assert langid.words_of("x²y ab½") == ["x", "y", "ab"] and langid.letter_runs("x²y") == [(0, 1), (2, 3)]


def test_long_words_count_whole(spark):
    """A word of one language of 60 letters outweighs one of the other of 50, by their letters."""
    gram = {g: np.log(np.array(p, np.float32)) for g, p in (("a", (0.9, 0.1)), ("b", (0.1, 0.9)))}
    label = langid.Labeller(langid.Model(["A", "B"], [frozenset(["latin"])] * 2, gram, np.log(np.full(2, 0.01, np.float32))), 0.0)
    assert label("a" * 60 + " " + "b" * 50)[0] == "A" and label("a" * 50 + " " + "b" * 60)[0] == "B"


def test_language_keeps_clashing_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({"score": F.lit(7), "Lang_Pred": F.lit("x"), "n_runs": F.lit(1), "found": F.lit(2), "_lang": F.lit(3)})
    kept = langid.keep_clear(docs)
    assert kept.columns == docs.columns and kept.where("score <> 7 or Lang_Pred <> 'x' or found <> 2").count() == 0
    assert len(langid.identify(docs, langid.fit(docs)).columns) == len(docs.columns) + 3


def test_language_path_is_the_best(spark):
    label = langid.Labeller(langid.Model([], [], {}, np.zeros(0)), 3.0)
    rng = np.random.default_rng(0)
    for _ in range(200):
        s = rng.normal(0, 2, (rng.integers(1, 7), 3)).astype(np.float32)
        cost = lambda p: sum(float(s[i, k]) for i, k in enumerate(p)) - 3.0 * sum(a != b for a, b in zip(p, p[1:], strict=False))  # noqa: B023, E731
        best = max(cost(p) for p in np.ndindex(*[3] * len(s)))
        assert math.isclose(cost(label.path(s).tolist()), best, abs_tol=1e-4)


def test_near_duplicates_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    shingle = neardup.Shingler()
    sets = {r["doc_id"]: set(shingle(r["text"])[1].tolist()) for r in docs.collect()}
    up = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = up[a], up[b]
                up = {k: min(x, y) if v in (x, y) else v for k, v in up.items()}
    assert {r["doc_id"]: r["class_id"] for r in neardup.classes(docs).collect()} == up
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r[0] for r in kept.select("doc_id").collect()) == sorted(set(up.values()))


def test_near_duplicates_on_hard_rows(hard, none):
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(hard).collect()}
    assert got[4] == got[8] == 4 and got[2] == got[3] == 2 and 1 not in got
    assert sorted(str(r["doc_id"]) for r in neardup.keep_one(hard).collect()) == ["1", "2", "4", "5", "6", "7", "None"]
    assert neardup.classes(none).count() == 0


def test_frequent_keys_are_not_dealt_by_key(spark, monkeypatch):
    """With every bucket above the bound the classes are the same; unlike texts under one id both stay."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = sorted(map(tuple, neardup.classes(docs).collect()))
    monkeypatch.setattr(neardup, "HOT", 2)
    assert sorted(map(tuple, neardup.classes(docs).collect())) == want
    left = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 1)], "key long, x int")
    right = spark.createDataFrame([(1, 50, "a"), (1, 50, "b"), (2, 1, "c")], "key long, n long, y string")
    assert neardup.beside(left, right).count() == 101
    plan = neardup.beside(left, right)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    two = spark.createDataFrame([(1, "one text here of some words indeed", "x"), (1, "quite another text with other words", "x"), (1, "quite another text with other words", "x")], "doc_id long, text string, key string")
    assert neardup.keep_one(two).count() == 2 and neardup.keep_one(two).columns == two.columns


def test_dart_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    e = rng.integers(0, 2**63, 40).astype(np.uint64)
    a, b = rng.uniform(0.2, 5, 40), rng.uniform(0.2, 5, 40)
    got = np.mean([(neardup.signature(e, a, seed=s) == neardup.signature(e, b, seed=s)).mean() for s in range(40)])
    assert abs(got - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {i: 100 for i in range(100, 140)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_language_model_equals_brute_force(spark, hard, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    got = {r["doc_id"]: r for r in ngram_lm.scores(docs, held, block_tokens=9000).collect()}
    words = {r["doc_id"]: [*ngram_lm.tokens_of(r["text"]), None] for r in docs.collect()}
    one, two, three = Counter(), Counter(), Counter()
    for i, w in words.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            one.update(w)
            two.update(zip([None, *w[:-1]], w, strict=True))
            three.update(zip([None, *w[:-2]], w[:-1], w[1:], strict=True))
    n, v, m = sum(one.values()), len(one), ngram_lm.PRIOR
    assert len(got) == len(words)
    for i, w in words.items():
        low = [(one[x] + 1) / (n + v + 1) for x in w]
        p = [two[u, x] / (one[u] + m) + m / (one[u] + m) * q for u, x, q in zip([None, *w[:-1]], w, low, strict=True)]
        for j, (u, y, x) in enumerate(zip([None, *w[:-2]], w[:-1], w[1:], strict=True), 1):
            p[j] = three[u, y, x] / (two[u, y] + m) + m / (two[u, y] + m) * p[j]
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(one[x] > 0 for x in w), n)
        assert math.isclose(r["base_score"], sum(map(math.log10, low)), rel_tol=1e-9)
        assert abs(r["score"] - sum(map(math.log10, p))) <= 0.02 * len(w)
    rows = ngram_lm.scores(hard, F.lit(False)).collect()
    assert len(rows) == 10 and sum(r["doc_id"] is None for r in rows) == 1
    assert ngram_lm.scores(none, F.lit(False)).count() == 0


@pytest.mark.parametrize(
    "text",
    [
        'api_key = ("AbC123xYz9Qw")', 'api_key = [\n  "AbC123xYz9Qw",\n]', 'secret = decode("AbC123xYz9Qw")', 'secret = base64.b64decode(\n    "AbC123xYz9Qw"\n).decode("utf8")', 'token =\n    "AbC123xYz9Qw"', 'password:\n  AbC123xYz9Qw\n',
        'secret: |\n  AbC123xYz9Qw\nother: 1', 'secret = """\nAbC123xYz9Qw\n"""', 'secret = "first9Zq" + \\\n  "AbC123xYz9Qw"', 'api_key = os.getenv("API_KEY_NAME", "AbC123xYz9Qw")', 'k = ("AbC123xYz9Qw")\npassword = k', 'const tokens = { "prod_token": f("AbC123xYz9Qw") };',
    ],
)
def test_secrets_in_brackets_calls_and_lines(text):
    assert "AbC123xYz9Qw" not in secrets.redact(text) and "<secret>" in secrets.redact(text)
    assert "API_KEY_NAME" in secrets.redact(text) or "API_KEY_NAME" not in text


def test_placeholders_are_whole_values_and_phrases_count():
    hit = lambda t: bool(secrets.literals(t))
    assert hit('my_key_passphrase = "correct horse battery staple"') and hit("passphrase: correct horse battery staple\n")
    assert not hit('password_text = "you must enter at least eight letters"') and not hit('title = "correct horse battery staple"')
    assert hit('client_secret = "9fExample7Q2sZxxxk1"') and hit('client_secret = "qZ7...k1Lw9"')
    assert not any(hit(f'client_secret = "{v}"') for v in ("your-api-key", "changeme", "example_secret", "xxxxxxxx", "${SECRET_KEY}", "<your secret here>"))


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, top in ((1, 5), (50, 60), (3000, 2**62)):
        v = np.sort(rng.integers(0, top, n).astype(np.uint64))
        e = elias_fano.EliasFano.of(v)
        assert (e.get(np.arange(n)) == v).all() and (e.get(np.array([n // 2])) == v[n // 2]).all()
        asked = rng.integers(0, top, 500).astype(np.uint64)
        for x, at in zip(asked.tolist(), e.find(asked).tolist(), strict=True):
            assert (at == -1) == (x not in set(v.tolist())) and (at < 0 or v[at] == x)
    c = np.repeat(np.sort(rng.integers(0, 2**63, 90).astype(np.uint64)), 30)
    w = rng.integers(0, 2**40, len(c)).astype(np.uint64)
    o = np.lexsort((w, c))
    code = rng.integers(1, 255, len(c)).astype(np.uint8)
    t = elias_fano.Trie.build(c[o], w[o], code).mapped()
    assert (t.lookup(c[o], w[o]) == code).all() and not t.lookup(c[o], w[o] ^ np.uint64(1)).any() and not t.lookup(c + np.uint64(1), w).any()
    empty = elias_fano.Trie.build(c[:0], w[:0], code[:0]).mapped()
    assert not empty.lookup(c[:3], w[:3]).any()


def test_numbers_keep_their_size():
    """Counts beyond 32 bits and probabilities below 10^-8 come back."""
    x = np.array([0, 1, 255, 1 << 32, (1 << 32) + 4, 1 << 50])
    assert (ngram_lm.unpacked(ngram_lm.packed(x)) == x).all() and len(ngram_lm.unpacked(ngram_lm.packed(x[:0]))) == 0
    rows = pd.DataFrame({"block": [1, 2], "part": [0, 0], "hashes": [np.array([7], np.uint64).tobytes()] * 2, "counts": [ngram_lm.packed(np.array([(1 << 32) + 4])), ngram_lm.packed(np.array([3]))]})
    assert ngram_lm.unpacked(ngram_lm._count_words(rows)["told"][0])[0] >> 1 == (1 << 32) + 7
    for p in (1.0, 1e-8, 1e-10, 1e-15):
        assert abs(math.log10(elias_fano.dequantise(elias_fano.quantise(np.array([p])))[0]) - math.log10(p)) <= 0.5 / elias_fano.STEPS + 1e-9


def test_the_model_is_stored_and_leaves_no_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    _, model = ngram_lm.fit_and_score(docs, F.lit(False), block_tokens=9000)
    rows = model.collect()
    tries = [elias_fano.Trie.load(np.frombuffer(bytes(r["trie"]), np.uint8)) for r in rows]
    assert {r["level"] for r in rows} == {2, 3} and sum(len(t.codes) for t in tries) > 1000
    t = max(tries, key=lambda t: len(t.codes))
    context, word = t.contexts.get(np.arange(1)), t.successors.get(np.arange(1)) & np.uint64((1 << t.bits) - 1)
    assert t.lookup(context, word)[0] == t.codes[0] > 0
    assert not [x.name for x in spark.catalog.listTables() if x.name.startswith("quarry_lm")]


def test_urls(spark):
    rows = [(1, None), (2, "no scheme"), (3, "http://A.Example.COM/en/7?x"), (4, "https://b.com/en/1#t"), (5, "http://x.net/de/8"), (6, "http://y.example.net/de/81"), (7, "http://cheap-pills.example.com/fr/1"), (8, "http://freecasinobonus.example.net/fr/1"), (9, "http://bcom/en/1"), (9, "a://b?c"), (10, "http://news.example.org/fr/2")]
    rows += [(100 + i, f"https://www.paper{i}.example.org/fr/{i}") for i in range(400)]  # what the classifier takes as usual
    u = url_filter.ruled(url_filter.parsed(spark.createDataFrame(rows, "page_id long, url string")))
    got = {(r["page_id"], r["host"]): r for r in url_filter.judge(u, url_filter.learn(u)).collect()}
    assert got[3, "a.example.com"]["rule"] == "example.com/en/7" and got[4, "b.com"]["rule"] == "com/en/" and got[4, "b.com"]["path"] == "/en/1"
    assert got[5, "x.net"]["ruled"] == "block" and got[6, "y.example.net"]["rule"] == "example.net/de/8" and got[9, "bcom"]["rule"] is None
    assert got[1, ""]["path"] == "" and got[9, "b"]["path"] == ""
    assert got[7, "cheap-pills.example.com"]["score"] > 0 and got[8, "freecasinobonus.example.net"]["score"] > 0 and got[10, "news.example.org"]["score"] < 0
    empty = url_filter.ruled(url_filter.parsed(spark.createDataFrame([], "page_id long, url string")))
    assert url_filter.judge(empty, url_filter.learn(empty)).count() == 0


@pytest.mark.parametrize("hot", [4, 200])
def test_a_hot_unwanted_host_keeps_its_score(spark, hot):
    """As a few rows, or as a third of all: on one host or on many, it is blocked, and a common word of other hosts is not."""
    usual = [(i, f"https://www.paper{i}.example.org/fr/farm/{i}") for i in range(2 * 200)]
    unwanted = [(1000 + i, f"http://{h}/fr/{i}") for i in range(hot // 2) for h in ("cheap-pills.example.com", f"spam-farm{i}.example.net")]
    u = url_filter.ruled(url_filter.parsed(spark.createDataFrame(usual + unwanted, "page_id long, url string")))
    for r in url_filter.judge(u, url_filter.learn(u)).collect():
        assert (r["score"] > 0) == (r["page_id"] >= 1000), r


def test_segmentation_is_the_cheapest():
    s = url_filter.Segmenter({"ab": 1.0, "abc": 1.5, "cd": 1.0, "d": 0.2})
    assert s("abcd") == ["abc", "d"] and s("") == [] and s("zzz") == ["zzz"] and s("zzabzz") == ["zzabzz"]
    rng = np.random.default_rng(6)

    def splits(name):
        """All ways to cut a name into known words and unknown runs, no two unknown ones together, with their costs."""
        if not name:
            yield [], 0.0, False
        for i in range(1, len(name) + 1):
            for rest, cost, unknown in splits(name[i:]):
                if name[:i] in words:
                    yield [name[:i], *rest], cost + words[name[:i]], False
                if not unknown:
                    yield [name[:i], *rest], cost + url_filter.WORD_COST + i * url_filter.UNKNOWN_LETTER, True

    for _ in range(150):
        words = {"".join(rng.choice(list("abc"), rng.integers(1, 4))): float(rng.uniform(0.5, 30)) for _ in range(6)}
        name = "".join(rng.choice(list("abc"), rng.integers(1, 9)))
        got = url_filter.Segmenter(words)(name)
        assert "".join(got) == name
        best = min(cost for _, cost, _ in splits(name))
        assert any(math.isclose(cost, best) for found, cost, _ in splits(name) if found == got), (words, name, got)


def test_words_learned_from_pages_split_names(spark):
    text = "the kitchen has recipes and the best car insurance for a photography school is in the best kitchen " * 40
    pages = spark.createDataFrame([(i, f"<p>{text}</p><script>var chpt</script><!-- itch -->") for i in range(5)] + [(9, None), (10, "")], "page_id long, html string")
    s = url_filter.Segmenter(url_filter.unigram(pages, url_filter.visible(F.col("html"))))
    assert s("photographyschool") == ["photography", "school"] and s("kitchenrecipes") == ["kitchen", "recipes"] and s("bestcarinsurance") == ["best", "car", "insurance"]
    assert "chpt" not in s.cost and "itch" not in s.cost and s("qzxvbnw") == ["qzxvbnw"]
    assert set(url_filter.unigram(pages.where("false"), url_filter.visible(F.col("html")))) == {w for x in url_filter.SEED for w in x.split()}


def test_words_outside_the_start_are_learned(spark):
    """Hosts that are unwanted by one word teach the other."""
    rows = [(i, f"http://www.paper{i}.example.org/{i}") for i in range(300)] + [(1000 + i, f"http://casino-zork{i}.example.com/") for i in range(20)] + [(2000, "http://zork.example.net/"), (2001, "http://" + "a" * 20000 + ".example.net/" + "b" * 20000)]
    rows += [rows[0], (None, "http://zork.example.net/")]
    u = url_filter.ruled(url_filter.parsed(spark.createDataFrame(rows, "page_id long, url string").withColumns({"words": F.lit(1), "by": F.lit(2), "host": F.lit("x")})))
    got = url_filter.judge(u, url_filter.learn(u)).collect()
    assert len(got) == len(rows)
    assert all((r["score"] > 0) == (r["page_id"] is None or 1000 <= r["page_id"] <= 2000) for r in got)


def test_url_scores_equal_a_plain_classifier(spark):
    """Counts, classes and scores by plain dictionaries over collected rows."""
    u = url_filter.ruled(url_filter.parsed(spark.read.parquet(f"{SF}/pages.parquet")))
    costs = url_filter.unigram(spark.read.parquet(f"{SF}/pages.parquet"), url_filter.visible(F.col("html")))
    segment, words, own = url_filter.Segmenter(costs), defaultdict(set), defaultdict(set)
    rows = u.collect()
    for r in rows:
        own[r["host"]] = {(True, w) for w in map(url_filter.bucket, url_filter.split_words(r["host"], "", segment))}
        words[r["host"]] |= own[r["host"]] | {(False, w) for w in map(url_filter.bucket, url_filter.split_words("", r["path"], segment))}
    start = Counter(url_filter.bucket(w) for s in url_filter.SEED for w in s.split())
    every = Counter(w for h in words.values() for _, w in h)
    got, unwanted, usual = Counter(), set(), {w: n for w, n in every.items() if w not in start}
    for _ in range(url_filter.ROUNDS + 1):
        n = len(url_filter.SEED) / (len(own) - len(unwanted))
        bad = {w: start[w] + n * usual.get(w, 0) + got[w] for w in set(start) | set(usual) | set(got)}
        v = len(set(every) | set(start)) + 1
        odds = {w: math.log((bad.get(w, 0) + 0.2) / (sum(bad.values()) + 0.2 * v)) - math.log((usual.get(w, 0) + 0.2) / (sum(usual.values()) + 0.2 * v)) for w in set(bad) | set(usual)}
        unwanted = {h for h, x in own.items() if url_filter.PRIOR + sum(odds.get(w, 0) for _, w in x) > 0}
        got = Counter(w for h in unwanted for _, w in words[h])
        usual = {w: n - got[w] for w, n in every.items()}
    for r in url_filter.judge(u, url_filter.learn(u, costs)).collect():
        found = url_filter.split_words(r["host"], "", segment) + url_filter.split_words("", r["path"], segment)
        assert r["words"] == " ".join(found) and math.isclose(r["score"], url_filter.PRIOR + sum(odds.get(url_filter.bucket(w), 0) for w in found), abs_tol=1e-6)


def test_graph_recall_and_links(spark):
    rng = np.random.default_rng(2)
    x = vectors.unit(rng.normal(size=(1500, 24)))
    x[700:900] = vectors.unit(x[5] + 0.02 * rng.normal(size=(200, 24)))
    g = hnsw.Graph.load(x.astype(np.float32), hnsw.Graph.build(x.astype(np.float32)).dump())
    assert vectors.recall(g, x, x, vectors.audited_beam(g, x, x[::5])) >= 0.98
    rows = [(i, v.tolist()) for i, v in enumerate(x[:950])] + [(950, None), (951, [0.0] * 24), (952, [float("nan")] * 24), (953, x[5].tolist()), (953, x[5].tolist()), (954, [1.0, 2.0]), (955, [])]
    got = {r["vec_id"]: r for r in vectors.components_of(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    y = vectors.unit(np.vstack([x[:950], x[5:6]]).astype(np.float32))
    links = (y @ y.T >= 0.9).sum(1) - 1
    ids = [*range(950), 953]
    assert sum(got[i]["n_links"] == n for i, n in zip(ids, links, strict=True)) >= 0.99 * len(ids)
    assert got[953]["component_id"] == 5 and got[954]["n_links"] == 0 and 950 not in got and 951 not in got and 952 not in got


def test_regions_leave_no_link_out(spark):
    """Clusters: counts and components equal brute force, and far regions are not asked."""
    rng = np.random.default_rng(11)
    x = vectors.unit(np.repeat(rng.normal(size=(30, 16)), 20, 0) + 0.12 * rng.normal(size=(600, 16)))
    rows = [(i, v.tolist(), "x", 1) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, shard string, node int")
    got = {r["vec_id"]: r for r in vectors.components_of(df, 12).collect()}
    near = x @ x.T >= 0.9
    up = np.arange(600)
    for _ in range(20):
        up = np.array([up[near[i]].min() for i in range(600)])
    assert [got[i]["n_links"] for i in range(600)] == (near.sum(1) - 1).tolist() and [got[i]["component_id"] for i in range(600)] == up.tolist()
    placed, middles = vectors.regions(df.select(F.lit(16).alias("dim"), F.col("vec_id").alias("node"), F.lit(1).cast("long").alias("copies"), F.col("embedding").alias("vector")), 12)
    shape = {(16, r["region"]): (r["a"], 1) for r in placed.groupBy("region").agg(F.max("angle").alias("a")).collect()}
    asked = vectors.routes(placed, middles, shape).agg(F.sum(F.size("shards"))).first()[0]
    assert asked < 0.9 * 600 * len(shape)


def test_vectors_of_wide_numbers_and_empty_tables(spark):
    rows = [(1, [1e200, 1e199]), (2, [1.0, 0.1]), (3, [1e-200, 1e-201]), (4, [0.0, 1.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.components_of(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4)}
    assert vectors.components_of(spark.createDataFrame([], "vec_id long, embedding array<float>, k1 int")).count() == 0


def test_audit_leaves_out_matches_with_oneself():
    """256 members that find themselves do not hide that 2 of 5 links are missed."""

    class Some:
        def search(self, queries, beam):
            s = queries @ x.T.astype(np.float32)
            if beam < 128:
                for i in (0, 1):  # what a narrow beam does not reach
                    s[queries @ x[i] > 0.999, 300 + i] = -1
            at = np.argsort(-s, 1)[:, :beam]
            return at, np.take_along_axis(s, at, 1)

    x = np.eye(400)
    x[300:305] = vectors.unit(x[:5] + 0.1 * x[300:305])
    own = np.arange(256)
    assert vectors.recall(Some(), x, x[own], 32, own=own) == pytest.approx(0.6)
    assert vectors.audited_beam(Some(), x, x[own], 32, own=own) == 128
    # Among many members without a link, those that have one are found.
    own = np.random.default_rng(0).permutation(400)
    assert vectors.true_links(x, x[own], own).sum() == 10 and vectors.audited_beam(Some(), x, x[own], own=own) == 128


def test_a_link_found_from_one_end_counts_for_both(spark, monkeypatch):
    """Searches that leave out every fifth link, and one that leaves out some from both ends."""
    real = vectors.linked

    def lossy(g, exact, queries, beam, threshold=vectors.THRESHOLD):
        q, x = real(g, exact, queries, beam, threshold)
        a, b = np.round(queries[q, 0] * 1e6).astype(np.int64), np.round(exact[x, 0] * 1e6).astype(np.int64)
        lost = (a + 2 * b) % 5 == 0
        return q[~lost], x[~lost]

    monkeypatch.setattr(vectors, "linked", lossy)
    rng = np.random.default_rng(3)
    x = vectors.unit(np.repeat(rng.normal(size=(40, 16)), 6, 0) + 0.1 * rng.normal(size=(240, 16))).astype(np.float32)
    y = vectors.unit(x)
    links = (y @ y.T >= 0.9).sum(1) - 1
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = {r["vec_id"]: r["n_links"] for r in vectors.components_of(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 2).collect()}
    lost = (lambda a: ((a[:, None] + 2 * a[None]) % 5 == 0))(np.round(y[:, 0] * 1e6).astype(np.int64))
    both = ((y @ y.T >= 0.9) & ~(lost & lost.T)).sum(1) - np.diag(~lost)
    assert all(both[i] <= got[i] <= links[i] for i in range(240))


def test_links_come_in_bounded_blocks(monkeypatch):
    """Many links of each vector, a few of some and none of others: no block holds them all, and together they are those of brute force."""
    monkeypatch.setattr(vectors, "PAIRS", 2000)
    rng = np.random.default_rng(4)
    x = vectors.unit(np.vstack([np.repeat(rng.normal(size=(2, 16)), 150, 0) + 0.05 * rng.normal(size=(300, 16)), rng.normal(size=(300, 16))]))[rng.permutation(600)]
    g, want = hnsw.Graph.build(x.astype(np.float32)), set(zip(*np.nonzero(x @ x.T >= 0.9), strict=True))
    blocks = list(vectors.brute(x, x))
    assert {p for _, _, q, y in blocks for p in zip(q, y, strict=True)} == want and all(b - a == 1 or len(q) <= 2000 for a, b, q, _ in blocks) and sum(b - a for a, b, _, _ in blocks) == 600
    blocks = list(vectors.links(g, x, x, 600))
    assert {p for q, y in blocks for p in zip(q, y, strict=True)} == want and max(len(q) for q, _ in blocks[1:]) <= 2000 < len(want)
    assert [len(q) for q, _ in vectors.links(g, x, x[:0], 600)] == []


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 5000])
def test_samples_round_trip(size):
    data = np.random.default_rng(size).integers(97, 110, size).astype(np.uint8).tobytes()
    payload = webp.padded(data)
    assert len(payload) % 64 == 0 and payload.startswith(data) and len(payload) >= 64
    assert b"".join(i.tobytes() for i in webp.decode_samples(webp.encode_samples(payload))) == payload
    noise = np.random.default_rng(1).bytes(64 * 300)
    assert b"".join(i.tobytes() for i in webp.decode_samples(webp.encode_samples(noise))) == noise


def _payloads():
    rng = np.random.default_rng(9)
    yield "zeros", bytes(64)
    yield "two values", bytes(rng.integers(0, 2, 640).astype(np.uint8) * 65 + 32)
    yield "sixteen values", bytes(rng.integers(97, 113, 6400).astype(np.uint8))
    yield "seventeen values", bytes(rng.integers(97, 114, 6400).astype(np.uint8))
    yield "all values", rng.bytes(64 * 700)
    line = b"License: some words that come again and again; no warranty.\n"
    yield "repeats", webp.padded(b"".join(line + rng.bytes(int(rng.integers(0, 90))) for _ in range(300)))
    yield "one run", webp.padded(b"ab" * 20000)
    yield "far", webp.padded(rng.bytes(400_000) + line * 3 + rng.bytes(700_000) + line)
    yield "walk", bytes((rng.integers(-1, 2, 64 * 90).cumsum() & 255).astype(np.uint8))
    yield "columns", bytes(((rng.integers(0, 256, 64)[None] + 7 * np.arange(120)[:, None]) & 255).astype(np.uint8).tobytes())


def test_forms_of_stored_files_round_trip():
    """Every way the encoder stores samples comes back, and each way is used."""
    seen = set()
    for name, payload in _payloads():
        media = webp.encode_samples(payload)
        assert b"".join(i.tobytes() for i in webp.decode_samples(media)) == payload, name
        assert len(media) <= len(payload) + 600, name
        x = np.frombuffer(payload, np.uint8)
        seen |= {("palette", len(np.unique(x)) <= 16), ("mode", webp.foretold(x.reshape(-1, 64))[0]), ("runs", bool(webp.repeats(x)))}
    assert seen >= {("palette", True), ("palette", False), ("mode", 0), ("mode", 1), ("mode", 2), ("runs", True), ("runs", False)}


def test_fast_and_plain_decoding_agree(monkeypatch):
    """The array decoder against the reader of one symbol after another."""
    for name, payload in _payloads():
        if len(payload) > 100_000:
            continue
        media = webp.encode_samples(payload)
        read = webp.read_pixels
        with monkeypatch.context() as m:
            m.setattr(webp, "read_pixels", lambda b, w, h, main: _plain_pixels(b, w, h, main, read))
            assert b"".join(i.tobytes() for i in webp.decode_samples(media)) == payload, name


def _plain_pixels(b, width, height, main, read):
    if not main:
        return read(b, width, height, main)
    assert b.read(1) == 0 and b.read(1) == 0
    green, red, blue, alpha, far = (webp.read_code(b, n) for n in (280, 256, 256, 256, 40))
    out = []
    while len(out) < width * height:
        s = green.read(b)
        if s < 256:
            r, bl = red.read(b), blue.read(b)
            out.append(alpha.read(b) << 24 | r << 16 | s << 8 | bl)
        else:
            length = webp._extended(b, s - 256)
            d = webp._extended(b, far.read(b)) - 120
            assert d > 0
            for _ in range(length):
                out.append(out[-d])
    return np.array(out, np.uint32)


def test_a_file_of_another_encoder():
    """A published one-pixel lossless file, known from feature tests of browsers."""
    import base64

    image = webp.decode(base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA=="))
    assert image.shape == (1, 1) and image.dtype == np.uint32


def test_media_figures_equal_plain_ones(spark):
    """Every column of the query from the texts alone, but for the stored form's, which decode to them."""
    import hashlib

    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    media = {r["doc_id"]: bytes(r["media"]) for r in webp.media_of(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    for r in webp.op8(spark, SF).collect():
        data = texts[r["doc_id"]]
        whole = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-64:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(media[r["doc_id"]]), hashlib.sha256(media[r["doc_id"]]).hexdigest())


def _image(width, height, transforms, symbols, cache_bits=0, inner=()):
    """A file whose main image is symbols: ('px', argb), ('ref', length, distance code) or ('hit', cache index)."""
    w = webp.Writer()
    w.put(0x2F, 8), w.put(width - 1, 14), w.put(height - 1, 14), w.put(1, 1), w.put(0, 3)

    def pixels(symbols, cache_bits, main):
        w.put(1, 1) if cache_bits else w.put(0, 1)
        if cache_bits:
            w.put(cache_bits, 4)
        if main:
            w.put(0, 1)
        sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
        streams = []
        for s in symbols:
            if s[0] == "px":
                streams.append([(0, s[1] >> 8 & 255), (1, s[1] >> 16 & 255), (2, s[1] & 255), (3, s[1] >> 24)])
            elif s[0] == "hit":
                streams.append([(0, 280 + s[1])])
            else:
                part = []
                for code, base, value in ((0, 256, s[1]), (4, 0, s[2])):
                    prefix = next(p for p in range(40) if (p < 4 and value == p + 1) or (p >= 4 and (lo := ((2 + (p & 1)) << ((p - 2) >> 1)) + 1) <= value < lo + (1 << ((p - 2) >> 1))))
                    part.append((code, base + prefix))
                    if prefix >= 4:
                        n = (prefix - 2) >> 1
                        part.append((-1, value - 1 - ((2 + (prefix & 1)) << n), n))
                streams.append(part)
        lengths = []
        for k, size in enumerate(sizes):
            n = np.bincount([x[1] for part in streams for x in part if x[0] == k] or [0], minlength=size)
            lengths.append(webp.huffman(n, 15))
            w.code(lengths[-1])
        codes = [webp.canonical(x) for x in lengths]
        for part in streams:
            for x in part:
                if x[0] < 0:
                    w.put(x[1], x[2])
                elif np.count_nonzero(lengths[x[0]]) > 1:
                    w.put(int(codes[x[0]][x[1]]), int(lengths[x[0]][x[1]]))

    for kind, *rest in transforms:
        w.put(1, 1), w.put(kind, 2)
        if kind in (webp.PREDICTOR, webp.CROSS_COLOUR):
            w.put(rest[0] - 2, 3)
            pixels([("px", p) for p in rest[1]], 0, False)
        elif kind == webp.PALETTE:
            w.put(len(rest[0]) - 1, 8)
            pixels([("px", p) for p in rest[0]], 0, False)
    w.put(0, 1)
    pixels(symbols, cache_bits, True)
    return webp.wrap(w.value.to_bytes(-(-w.at // 8), "little"))


def test_back_references_and_cache():
    a, b = 0xFF102030, 0x80A0B0C0
    slot = (webp.HASH * a & 0xFFFFFFFF) >> 29
    got = webp.decode(_image(4, 3, [], [("px", a), ("px", b), ("ref", 5, 122), ("hit", slot), ("ref", 4, 1)], 3)).ravel().tolist()
    want = [a, b]
    for _ in range(5):
        want.append(want[-2])
    want.append(a)
    for _ in range(4):
        want.append(want[-4])  # the first near pixel is the one above
    assert got == want


@pytest.mark.parametrize("mode", range(14))
def test_predictors_invert(mode):
    rng = np.random.default_rng(mode)
    image = rng.integers(0, 2**32, (6, 9), dtype=np.uint32)
    c = webp.channels(image).tolist()
    residual = []
    for y in range(6):
        for x in range(9):
            if y and x:
                p = webp.predict(mode, c[y][x - 1], c[y - 1][x], c[y - 1][x + 1] if x < 8 else c[y][0], c[y - 1][x - 1])
            else:
                p = c[y][x - 1] if x else c[y - 1][x] if y else [0, 0, 0, 255]
            residual.append(int(webp.joined(np.array([(a - b) & 255 for a, b in zip(c[y][x], p, strict=True)]))))
    media = _image(9, 6, [(webp.PREDICTOR, 2, [0xFF000000 | mode << 8] * 6)], [("px", p) for p in residual])
    assert (webp.decode(media) == image).all()


def test_colour_transforms_and_palette():
    rng = np.random.default_rng(5)
    image = rng.integers(0, 2**32, (4, 5), dtype=np.uint32)
    green = webp.channels(image)
    green[..., 0] = (green[..., 0] - green[..., 1]) & 255
    green[..., 2] = (green[..., 2] - green[..., 1]) & 255
    assert (webp.decode(_image(5, 4, [(webp.SUBTRACT_GREEN,)], [("px", int(p)) for p in webp.joined(green).ravel()])) == image).all()
    r2b, g2b, g2r = 40, -30, 25
    signed = lambda v: ((int(v) & 255) ^ 128) - 128
    c = webp.channels(image)
    for p in c.reshape(-1, 4):
        red = p[2]
        p[2] = (p[2] - (g2r * signed(p[1]) >> 5)) & 255
        p[0] = (p[0] - (g2b * signed(p[1]) >> 5) - (r2b * signed(red) >> 5)) & 255
    by = 0xFF000000 | (r2b & 255) << 16 | (g2b & 255) << 8 | (g2r & 255)
    assert (webp.decode(_image(5, 4, [(webp.CROSS_COLOUR, 2, [by, by])], [("px", int(p)) for p in webp.joined(c).ravel()])) == image).all()
    colours = [0xFF000001, 0x00000102]  # the second is a difference
    index = rng.integers(0, 2, (2, 11))
    packed = [sum(int(v) << i for i, v in enumerate(row[a : a + 8])) for row in index for a in (0, 8)]
    got = webp.decode(_image(11, 2, [(webp.PALETTE, colours)], [("px", 0xFF000000 | p << 8) for p in packed]))
    assert (got == np.array([0xFF000001, 0xFF000103], np.uint32)[index]).all()


def test_media_on_hard_rows(spark, hard, none):
    rows = {r["doc_id"]: r["media"] for r in webp.media_of(hard).collect()}
    assert rows[1] == rows[2] and rows[4] == rows[8]
    assert b"".join(i.tobytes() for i in webp.decode_samples(rows[5])).rstrip(b"\0").decode() == "word " * 30000
    assert webp.media_of(none).count() == 0


@pytest.mark.parametrize("number", range(5))
def test_pipeline_stages_on_hard_rows(spark, hard, none, number):
    """Nulls, empty and long texts, repeats, clashing columns and no rows: defined results, and the columns of documents from all but the last."""
    import corpus_pipeline

    name, stage = corpus_pipeline.STAGES[number]
    clash = hard.withColumns({c: F.lit("y") for c in ("score", "lang_pred", "n_runs", "digest", "n", "i", "place", "class", "copies_", "found")})
    out = stage(spark, clash, SF)
    rows = out.collect()
    if number < 4:
        assert out.columns == clash.columns
        assert stage(spark, none, SF).columns == none.columns
    assert stage(spark, none, SF).count() == 0
    ids = Counter(r["doc_id"] for r in rows)
    if name == "language_id":
        assert not {1, 2, 3, 7} & set(ids)
    if name == "near_dedup":
        assert ids == Counter({1: 1, 2: 1, 4: 1, 5: 1, 6: 1, 7: 1, None: 1})
    if name == "secret_scan":
        assert len(rows) == 10 and "hunter2hunter" not in "".join(r["text"] or "" for r in rows) and [r["text"] for r in rows if r["doc_id"] == 1] == [None]
    if name == "mixing":
        assert all(n <= 4 for n in ids.values())
    if name == "packing":
        assert ids[1] == 1 and ids[4] == 2 and ids[None] == 1 and ids[5] > 20


def test_workers_need_no_copy_of_the_package(tmp_path):
    """Every query in a session whose workers cannot import the package."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[2]
    script = tmp_path / "run.py"
    script.write_text(f"""
import sys
sys.path.insert(0, {str(root)!r})
from pyspark.sql import SparkSession
import __spark_entry__
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.warehouse.dir", {str(tmp_path / "w")!r}).getOrCreate()
seen = spark.range(1).selectExpr("1 as x").mapInPandas(lambda b: b, "x int").count()
from pyspark.sql import functions as F
@F.udf("string")
def can(x):
    try:
        import quarry
        return "yes"
    except ImportError:
        return "no"
assert spark.range(1).select(can("id")).first()[0] == "no"
for name, q in __spark_entry__.queries().items():
    if name == "pipeline" or name[:2] == "op" and name[2].isdigit():
        print(name, q(spark, {SF!r}).count(), flush=True)
""")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-3000:]
    assert len([x for x in done.stdout.splitlines() if x.startswith(("op", "pipeline"))]) == 11


def test_pipeline_equals_a_plain_version(spark):
    """The stages' own decisions one after another, on collected rows."""
    import corpus_pipeline
    import public_tokenizers

    got = corpus_pipeline.run(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    label = langid.Labeller(langid.fit(docs))
    kept = [r for r in docs.collect() if label(r["text"])[0] != "und" and label(r["text"])[1] >= langid.KEEP_SCORE]
    named = {r["doc_id"]: r["class_id"] for r in neardup.classes(docs).collect()}
    kept = [r for r in kept if named[r["doc_id"]] == r["doc_id"]]
    texts = {r["doc_id"]: secrets.redact(r["text"]) for r in kept}
    encode = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = {i: len(packing.cut(len(encode(t)) // 4 + 1)) for i, t in texts.items()}
    n = Counter(r["doc_id"] for r in got)
    assert set(n) <= set(texts) and all(n[i] % pieces[i] == 0 and n[i] <= 2 * pieces[i] for i in n)
    words = sum(len(t.split()) for t in texts.values())
    taken = sum(len(texts[i].split()) * (n[i] // pieces[i]) for i in n)
    assert abs(taken - 1.5 * words) < 0.15 * words
    first = {r["doc_id"]: r for r in got if r["piece"] == 0}
    for i, r in first.items():
        ids = encode(texts[i]) + np.asarray([2], "<u4").tobytes()
        assert r["ids_crc32"] == zlib.crc32(ids[: 4 * r["length"]])
