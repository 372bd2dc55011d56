"""The operators against brute force, exact round trips and held-out rows; odd inputs for each of them."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parchlake.llm import decontam, langid, nearjoin, pieces, quality, secretscan, sharding, tokencount, urlfilter, warc
from parchlake.llm.common import shared_dir

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 30_000


def docs(spark, texts, extra=""):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


ODD = [None, "", " \n\t ", "one", "one two three four", "é ▁ 漢字 😀\x00\n\n", "same text here", "same text here", LONG]


def jaccard_components(texts):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        x = len(sets[i] & sets[j])
        if x and 100 * x >= 80 * (len(sets[i]) + len(sets[j]) - x):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


def corpus(seed, n):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choices("abcdef", k=4))
    passage = [word() for _ in range(60)]
    out = []
    while len(out) < n:
        base = [word() for _ in range(rnd.choice([3, 5, 7, 12, 20, 40, 90, 200]))]
        if rnd.random() < 0.3:
            base[len(base) // 2 : len(base) // 2] = passage
        for _ in range(rnd.choice([1, 1, 2, 4, 30])):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2])):
                w[rnd.randrange(len(w))] = word()
            out.append(" ".join(w))
    return out[:n]


@pytest.mark.parametrize("seed", [1, 2])
def test_join_components(spark, seed):
    texts = corpus(seed, 300) + ODD
    got = {r["doc_id"]: (r["n"], r["component_id"]) for r in nearjoin.linked(docs(spark, texts)).collect()}
    assert got == jaccard_components(texts)


@pytest.mark.parametrize(("local", "block"), [(1_000_000, 2048), (0, 4)])
def test_join_of_hot_lists(spark, local, block):
    """Texts of a shared passage and a few own words: most lists are long, and many components remain between them."""
    rnd = random.Random(9)
    passage = [f"p{k}" for k in range(40)]
    texts = [" ".join([*(f"own{i}x{k}" for k in range(rnd.randrange(14))), *passage, *(f"end{i % 40}x{k}" for k in range(rnd.randrange(6)))]) for i in range(160)]
    texts += [" ".join(rnd.choice([f"a{k}", f"b{k}"]) if k % 6 == 0 else f"w{k}" for k in range(50)) for _ in range(160)]
    d = docs(spark, texts)
    got = {r["id"]: (r["n"], r["component_id"]) for r in nearjoin._placed(d, "doc_id", "text", local, block).collect()}
    assert got == jaccard_components(texts)


def test_lists_longer_than_a_batch(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7000)
    try:
        rows = [(5, 30, k, 0) for k in range(40_000)] + [(5, 30, k, 0) for k in range(0, 40_000, 3)] + [(7, 30, k, 0) for k in range(10)] + [(9, 30, 3, 0)]
        got = nearjoin._scanned(spark.createDataFrame(rows, "key long, n long, node long, at int"), 3).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(r["a"] for r in got if r["b"] is None) == list(range(40_000))
    pairs = {tuple(sorted((r["a"], r["b"]))) for r in got if r["b"] is not None}
    h = {r["node"]: r["h"] for r in spark.range(40_000).select(F.col("id").alias("node"), F.xxhash64("id", F.shiftright(F.lit(5).cast("long"), 1).bitwiseAND(nearjoin.ORDERS - 1)).alias("h")).collect()}
    order = sorted(h, key=h.get)
    want = {tuple(sorted(x)) for x in [*zip(order, order[1:]), *((order[0], k) for k in order[1:])]}
    assert pairs == want | set(itertools.combinations(range(10), 2))


def test_bitmaps_rule_out_no_link():
    rnd = np.random.default_rng(4)
    for _ in range(300):
        a = np.unique(rnd.integers(0, 2**63, int(rnd.integers(1, 300))).astype(np.uint64))
        b = np.unique(np.concatenate([a[rnd.random(len(a)) < rnd.choice([0.7, 0.85, 0.95])], rnd.integers(0, 2**63, int(rnd.integers(0, 1 + len(a) // 4))).astype(np.uint64)]))
        x, y = (np.frombuffer(nearjoin.bitmap(s), np.uint64) for s in (a, b))
        size = min(len(x), len(y))
        common = len(np.intersect1d(a, b))
        if 100 * common >= 80 * (len(a) + len(b) - common):
            most = nearjoin.most_common(len(a), nearjoin.folded(x, size), len(b), nearjoin.folded(y, size))
            assert common <= most and nearjoin.enough(most, len(a), len(b))


def test_join_meeting_places():
    rnd = np.random.default_rng(3)
    none = np.zeros((1 << 24) // 8, np.uint8)
    for _ in range(300):
        n = int(rnd.integers(4, 60))
        a = np.unique(rnd.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[rnd.random(len(a)) < 0.93], rnd.integers(0, 2**63, 2).astype(np.uint64)]))
        x = len(np.intersect1d(a, b))
        if 100 * x >= 80 * (len(a) + len(b) - x):
            for boundary in (3, 20, 34, 100):
                ka, kb = (nearjoin.keys_of(nearjoin.in_order(s, none), boundary)[0] for s in (a, b))
                assert len(a) < 4 or len(b) < 4 or len(np.intersect1d(ka, kb))


def test_join_boundary_by_cost():
    assert nearjoin.boundary_by_cost({}) == 3
    assert 3 <= nearjoin.boundary_by_cost({500: 1000}) and nearjoin.boundary_by_cost({10: 1000, 500: 1000}) >= 10


def test_keep_one(spark):
    texts = corpus(5, 120) + ODD
    want = {c for _, c in jaccard_components(texts).values()}
    kept = nearjoin.keep_one(docs(spark, texts))
    assert {r["doc_id"] for r in kept.collect()} == want and kept.columns == docs(spark, []).columns
    assert nearjoin.keep_one(docs(spark, ["a b c d e f"]).union(docs(spark, ["a b c d e f"]))).count() == 1
    assert nearjoin.linked(docs(spark, [])).count() == 0


def test_keep_one_of_shared_and_null_ids(spark):
    base = [f"w{k}" for k in range(60)]
    near = [" ".join([*base, f"tail{i}"]) for i in range(3)]
    other = "another text of quite other words"
    rows = [(7, near[0]), (7, near[1]), (9, near[2]), (None, other), (None, other + " x y z"), (None, other), (None, ""), (None, None), (3, " "), (3, " "), (7, "short text")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [(r["doc_id"], r["text"]) for r in nearjoin.keep_one(d).collect()]
    assert sum(t in near for _, t in kept) == 1 and (9, near[2]) not in kept and (7, "short text") in kept
    assert kept.count((None, other)) == 1 and kept.count((3, " ")) == 2 and kept.count((None, "")) == kept.count((None, None)) == 1
    nulls = spark.createDataFrame([(None, t) for t in near], "doc_id long, text string")
    assert nearjoin.keep_one(nulls).count() == 1


def words(t):
    low = "".join(c.lower() if c.isascii() else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def contaminated(texts, items):
    out = {}
    wins = {}
    for k, t in items:
        w = words(t)
        n = min(8, len(w))
        wins.setdefault(str(k), set()).update(tuple(w[i : i + n]) for i in range(len(w) - n + 1) if n)
    for d, t in enumerate(texts):
        w = words(t)
        hit, found = set(), set()
        for k, ws in wins.items():
            for win in ws:
                for i in range(len(w) - len(win) + 1):
                    if tuple(w[i : i + len(win)]) == win:
                        hit |= set(range(i, i + len(win)))
                        found.add(k)
        out[d] = (len(w), len(hit), sorted(found))
    return out


@pytest.mark.parametrize("rows", [200_000, 0])
def test_decontamination(spark, rows):
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choices("abÉ1", k=3))
    items = [(i, " ".join(word() for _ in range(rnd.choice([3, 8, 9, 20])))) for i in range(12)] + [(50, None), (51, "!!"), (12, "x y z X Y Z x y z x y z")]
    texts = [" ".join(word() for _ in range(40)) for _ in range(30)]
    for k in range(0, 30, 3):
        texts[k] = f"{texts[k]}, {items[k % 12][1].upper().replace('é', 'É')} -- {items[(k + 1) % 12][1]}."
    texts += [*ODD, "x y z x y z x y z x y z x y z"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    d = docs(spark, texts)
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], list(r["items"])) for r in decontam.contaminated(d, bench, broadcast_rows=rows).collect()}
    assert got == contaminated(texts, items)
    cleaned = {r["doc_id"]: r["text"] for r in decontam.clean(d, bench, broadcast_rows=rows).collect()}
    for i, (_, n_hit, found) in contaminated(texts, items).items():
        assert (i in cleaned) == (len(found) < 2)
        if i in cleaned:
            assert cleaned[i] == texts[i] if not n_hit else len(words(cleaned[i])) < len(words(texts[i]))
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contaminated(d, empty).where("contaminated or n_hit > 0").count() == 0
    assert decontam.contaminated(docs(spark, []), bench).count() == 0


def test_pieces(spark):
    rnd = random.Random(1)
    texts = [*ODD, "  two  spaces ▁▁ mark ", "x" * 5000, *("".join(rnd.choices("ab é漢\n▁ 😀\x01the ing", k=rnd.randrange(200))) for _ in range(200))]
    v = pieces.vocabulary(open(pieces.default_model(), "rb").read())
    for r in pieces.encode_texts(docs(spark, texts)).collect():  # a difference from the library raises
        ids = [int(x) for x in r["ids"].split(",") if x]
        assert ids == v.library.encode(texts[r["doc_id"]] or "") and r["decoded"] == v.library.decode(ids) == v.decode(ids) and r["n_tokens"] == len(ids)
    by_number = {r["doc_id"]: r["ids"] for r in pieces.encode_texts(docs(spark, texts), numbers=True, check=False).collect()}
    assert by_number == {i: v.library.encode(t or "") for i, t in enumerate(texts)}
    assert pieces.encode_texts(docs(spark, [])).count() == 0 and v.plain
    own = pieces.Vocabulary(open(pieces.default_model(), "rb").read())
    own.plain = False  # as if a text did not decode to itself
    assert [x for _, x in own.encoded([t or "" for t in texts])] == [x for _, x in v.encoded([t or "" for t in texts])]
    own.memo = {}
    words = ["".join(rnd.choices("abcdefgéß漢.,\x02zeition", k=rnd.randrange(1, 40))) for _ in range(3000)]
    assert all(np.frombuffer(x, np.int32).tolist() == own.agenda(w) for w, x in own.agendas(words).items())


def test_vocabularies_behind_a_task(spark, tmp_path):
    """A worker keeps the vocabulary for its next task if memory is no matter, and drops it otherwise."""

    def held(key):
        seen = lambda batches: (pa.RecordBatch.from_pydict({"x": [key in pieces._READ]}) for b in batches)
        return any(r["x"] for r in spark.range(0, 64, 1, 16).mapInArrow(seen, "x boolean").collect())

    for value, remember in ((1, pieces.MOST), (2, 1000)):
        model = open(pieces.default_model(), "rb").read() + b"\xb0\x09" + bytes([value])  # a field that no reader knows
        (tmp_path / "own.model").write_bytes(model)
        got = pieces.encode_texts(docs(spark, ODD * 8), str(tmp_path / "own.model"), numbers=True, remember=remember)
        assert got.count() == 8 * len(ODD) and sum(r["n_tokens"] for r in got.collect()) > 0
        assert held(hashlib.sha256(model).hexdigest()) == (remember == pieces.MOST)


def test_token_counts(spark):
    v = pieces.vocabulary(open(pieces.default_model(), "rb").read())
    scores, byte = tokencount.zipf_scores(v)

    def best(word):
        t = pieces.MARK + word
        top = [(0.0, 0)]
        for i in range(1, len(t) + 1):
            found = [(top[j][0] + scores[t[j:i]], -top[j][1] - 1) for j in range(i) if t[j:i] in scores]
            if t[i - 1] not in scores:
                n = len(t[i - 1].encode())
                found.append((top[i - 1][0] + n * byte, -top[i - 1][1] - n))
            s, n = max(found)
            top.append((s, -n))
        return top[-1][1]

    texts = [*ODD[:-1], "the theory of theorems then", "word " * 50, "漢漢字 x漢", "a" * 300]
    for r in tokencount.count_tokens(docs(spark, texts)).collect():
        w = [x.decode() for x in (texts[r["doc_id"]] or "").encode().split()]
        assert (r["n_pretokens"], r["n_tokens"]) == (len(w), sum(map(best, w)))
    small = tokencount.PieceTrie(scores, byte, max_nodes=20)
    large = tokencount.PieceTrie(scores, byte)
    for w in (b"theory", b"theorem", b"then", b"other", b"theory"):
        assert small.insert(w) == large.insert(w) == best(w.decode())
    assert large.made < sum(map(len, ("_theory", "_theorem", "_then", "_other")))


def test_sharding(spark):
    rnd = random.Random(2)
    texts = [*ODD[:-1], *["hot copy of a text"] * 400, *("x" * rnd.randrange(300) + str(i) for i in range(800))]
    got = sharding.shard(docs(spark, texts), ranges=32, sample=256).collect()
    assert len(got) == len(texts)
    size = {k: 0 for k in range(16)}
    for r in got:
        t = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(t) + 1 and r["text_crc32"] == __import__("zlib").crc32(t)
        size[r["shard"]] += r["size"]
    for k in range(16):
        slots = sorted(r["slot"] for r in got if r["shard"] == k)
        assert slots == list(range(len(slots)))
    mean = sum(size.values()) / 16
    assert max(abs(s - mean) for s in size.values()) < 0.1 * mean
    where = {}
    for r in got:
        where.setdefault(texts[r["doc_id"]] or "", set()).add(r["shard"])
    assert all(len(s) == 1 for t, s in where.items() if t != "hot copy of a text")
    assert sharding.shard(docs(spark, [])).count() == 0


def test_secrets(spark):
    hexes, key = "0123456789abcdef" * 2, "AKIA" + "A1" * 10
    texts = [*ODD, f'é token = "{hexes}" x', f"API_KEY: ab12 {key}Z password=hunter22, secret : 'a/b.c=d-e_f+'", "login: Tr0ub4dor&3x9 pwd: password pass is qwertyuiop", "AKIASHORT apikey=12345"]
    base = {"assign": r"(?ai:(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+))", "access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+"}
    for r in secretscan.find_secrets(docs(spark, texts)).collect():
        t = texts[r["doc_id"]] or ""
        want = [(m.start(), n, k, m.end()) for n, (k, p) in enumerate(base.items()) for m in re.finditer(p, t) if (len(m[2]) >= 6 if k == "assign" else len(m[0]) >= (20 if k == "access" else 24))]
        assert [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["kind"] != "guess"] == [(k, s, e) for s, _, k, e in sorted(want)]
    guesses = {t[s:e] for t in texts if t for s, e, k in secretscan.scan(t.encode()) if k == "guess"}
    assert guesses == {"Tr0ub4dor&3x9"}
    masked = [r["text"] for r in secretscan.redact(docs(spark, texts)).orderBy("doc_id").collect()]
    assert hexes not in masked[9] and masked[9].startswith("é [SECRET]") and masked[: len(ODD)] == ODD
    assert secretscan.find_secrets(docs(spark, [])).count() == 0


def test_guess_costs():
    g = secretscan.guess_bits
    assert g("password") == 0 and g("aaaaaaaa") < 10 and g("qwertyuiop") < 15 and g("20190131") < 20 and g("password2019") < 20
    assert g("x7#Kp2!qLz") > 40 and g("abcabcabc") < g("abcxyzkqp") and g("") == 0


def test_long_values_are_secret_as_a_whole():
    rnd = random.Random(8)
    jwt = "eyJ" + "".join(rnd.choices("abcXYZ019_-.", k=700))
    odd = "x" + "".join(rnd.choices("жшщюяы", k=200)) + "1"
    hexes = "0123456789abcdef" * 2
    text = f"auth: {jwt}, auth: {odd} then {hexes} é {hexes}"
    at = [text.index(jwt), text.index(odd), text.index(hexes), text.rindex(hexes)]
    want = [(a, a + len(t), k) for a, t, k in zip(at, (jwt, odd, hexes, hexes), ("guess", "guess", "hex", "hex"), strict=True)]
    assert [x for x in secretscan.scan(text.encode()) if x[2] == "guess" or x[:2] in {w[:2] for w in want}] == want
    assert secretscan.redacted(text, secretscan.scan(text.encode())) == "auth: [SECRET], auth: [SECRET] then [SECRET] é [SECRET]"
    for v in ("x7#" * 30 + "a" * 500 + "Kq!9", "qwerty" * 40, "Zk3!" + "1" * 300):
        assert (secretscan.guess_bits(v, 28.0) >= 28) == (secretscan.guess_bits(v) >= 28)


def test_ordinary_values_are_no_secrets():
    clean = ["password is case-sensitive", "login: https://example.com/account", "login: https://accounts.github.com/settings/profile?tab=security", "login: 12:30:45", "auth: read-only", "token is 2019-01-31", "passcode: e-mail", "pass: Straße2"]
    assert [t for t in clean if secretscan.scan(t.encode())] == []
    for v in ("https://example.com/x7#Kp2!qLz9vTw", "https://x.net/a?key=xK9qLz7vTwPm", "x7-Kp2_qLz:9vTw", "12:30:45:x7#Kp2!qLz"):
        assert secretscan.scan(f"login: {v}".encode())[-1] == (7, 7 + len(v), "guess")


def test_loose_forms_and_letters_alone():
    for before, v in [("login: ", "xkqvbnzjtrpw"), ("pwd: ", "QmWzKxTrVbNp"), ("pwd ", "Xk9#mQ2!v"), ("pwd:\t", "Xk9#mQ2!v"), ("Password\r\n ", "Xk9#mQ2!v"), ("pass\tis\n", "Xk9#mQ2!v"), ("login token ", "Xk9#mQ2!v"), ("auth = password: ", "Xk9#mQ2!v")]:
        text = f"{before}{v}. It"
        assert secretscan.scan(text.encode()) == [(len(before), len(before) + len(v), "guess")], text
    clean = "The secret ingredient is through. Login required; a token passed, a password manager, pass through\nauth: disabled. Credentials: unknown"
    assert secretscan.scan(clean.encode()) == [] and secretscan.scan(b"password" + b" " * 300_000) == []


def test_passages_once_a_batch_are_frequent(spark):
    passage = " ".join(f"shared{k}" for k in range(20))
    texts = [" ".join(f"own{i}x{k}" for k in range(30)) + " " + passage for i in range(60)]
    frequent = np.unpackbits(nearjoin._survey(docs(spark, texts).repartition(60), "text")[0])
    at = lambda t: frequent[(nearjoin.shingles(t.encode()) >> np.uint64(65 - len(frequent).bit_length())).astype(np.int64)]
    assert at(passage).all() and frequent.sum() == 16 and not at(" ".join(f"own0x{k}" for k in range(30))).any()


def test_counts_are_sent_in_small_batches(spark, monkeypatch):
    """The counts of all shingles (134 MB or more) never leave a worker, or enter one, as one batch."""
    from parchlake.llm import common

    sent, made = spark.sparkContext.accumulator(0), []

    def watched(df, fn, schema):
        def run(batches):
            for b in fn(batches):
                sent.add(b.nbytes > 4 << 20)
                yield b

        made.append(schema)
        return common.in_arrow(df, run, schema)

    monkeypatch.setattr(nearjoin, "in_arrow", watched)
    texts = corpus(3, 200)
    frequent, boundary = nearjoin._survey(docs(spark, texts).coalesce(1), "text")
    assert len(made) == 2 and sent.value == 0
    bits = nearjoin.table_bits(len(texts))
    counts = np.bincount(np.concatenate([nearjoin.shingles(t.encode()) for t in set(texts)]) >> np.uint64(64 - bits), minlength=1 << bits)
    chance = counts.sum() / (1 << bits)
    assert (np.unpackbits(frequent) == (counts >= nearjoin.FREQUENT + chance + 6 * chance**0.5)).all() and frequent.any()
    sizes = [len(nearjoin.shingles(t.encode())) for t in set(texts)]
    assert boundary == nearjoin.boundary_by_cost({n: sizes.count(n) for n in set(sizes) if n <= nearjoin.SIZES})


def test_quality(spark):
    rnd = random.Random(4)
    texts = [*ODD, *(" ".join(rnd.choices(["a", "bb", "c*", "dé", "\n", "x y\n"], k=rnd.randrange(200))) for _ in range(60)), "clean words " + " ".join(f"w{i}x" for i in range(80))]
    for r in quality.rule_stats(docs(spark, texts)).collect():
        t = texts[r["doc_id"]] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        hit = {i + k for i, x in enumerate(grams) if grams.count(x) > 1 for k in range(3)} if len(w) < 5000 else set(range(len(w)))
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit))
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert r["base_failed"] == (len(w) < 50 or 100 * len(hit) > 50 * len(w)) and not (r["base_failed"] and r["kept"])
    kept = {r["doc_id"] for r in quality.rule_stats(docs(spark, texts)).where("kept").collect()}
    for order in itertools.islice(itertools.permutations(quality.RULES), 0, 120, 40):
        assert {r["doc_id"] for r in quality.keep_good(docs(spark, texts), order=list(order)).collect()} == kept
    assert len(texts) - 1 in kept and quality.rule_stats(docs(spark, [])).count() == 0


def test_urls(spark):
    urls = [None, "", "no scheme", "http://a.com/x", "http://notcom/x", "https://Example.COM/en/1?q#f", "http://www.example.com/en/", "http://x.net/es/1", "http://x.net?es/", "ftp://h#/net/es/", "http://net/fr/a://b", "http://x.org/a/b"]
    got = {r["page_id"]: r for r in urlfilter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    for i, u in enumerate(urls):
        m = re.match(r".*?://([^/?#]*)([^?#]*)", u or "", re.S)
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fit = [(h + p, v) for h, p, v in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fit, key=lambda x: len(x[0]), default=None)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule and rule[0])
        assert got[i]["verdict"] == rule[1] if rule else got[i]["verdict"] in ("allow", "block")
    assert urlfilter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_trees_on_held_out_rows(spark):
    rows = urlfilter.parsed(spark.read.parquet("/root/testdata/sf0.1/pages.parquet"), "page_id", "url").where("rule is not null").collect()
    half = spark.createDataFrame([r for r in rows if r["id"] % 2], "id long, url string, host string, path string, rule string, verdict string")
    rates, overall, trees = urlfilter.trained(half)
    rest = [r for r in rows if r["id"] % 2 == 0]
    x = np.array([urlfilter.lexical(r["url"], r["host"], r["path"], rates, overall) for r in rest])
    right = ((trees.logit(x) > 0) == np.array([r["verdict"] == "block" for r in rest])).mean()
    majority = max(np.mean([r["verdict"] == v for r in rest]) for v in ("allow", "block"))
    assert right >= max(0.8, majority)


def test_warc(spark):
    html = ["<p>é</p>\r\n\r\nWARC/1.1\r\n", None, "", "<p>é</p>\r\n\r\nWARC/1.1\r\n", "x" * 200_000, "y"]
    rows = [(i, f"http://b.example.com/{i % 2}?q\r\nX: y" if i else None, h) for i, h in enumerate(html)] + [(None, "http://a/", "y")]
    rows += [(100 + i, "http://hot.example/", "same") for i in range(50)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    runs = warc.read_runs(spark, warc.write_warc(df, shared_dir(spark, "test-warc")))
    got = warc.merge_index(runs, rows_per_range=20).collect()
    assert len(got) == len(rows) and [warc.order_of(tuple(r)) for r in got] == sorted(warc.order_of(tuple(r)) for r in got)
    top = {}
    for i, _, h in rows:
        top[h or ""] = max(x for x in (top.get(h or ""), i) if x is not None) if (top.get(h or ""), i) != (None, None) else None
    by = {r["page_id"]: r for r in got}
    for i, _, h in rows:
        r, raw = by[i], (h or "").encode()
        assert r["payload_bytes"] == len(raw) and r["payload_digest"] == __import__("base64").b32encode(hashlib.sha1(raw).digest()).decode()
        assert (r["record_type"], r["refers_to"]) == (("response", None) if i == top[h or ""] else ("revisit", top[h or ""]))
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.merge_index(warc.read_runs(spark, warc.write_warc(empty, shared_dir(spark, "test-warc")))).count() == 0


def test_loser_tree():
    rnd = random.Random(3)
    for k in range(0, 9):
        runs = [sorted((rnd.randrange(20), j) for _ in range(rnd.randrange(6))) for j in range(k)]
        assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def test_languages(spark):
    all_ = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    langs, model = langid.train(all_.where("doc_id % 2 = 0"))
    rest = all_.where("doc_id % 2 = 1 and n_chars > 100").collect()
    right = np.mean([langs[langid.likelihoods(r["text"].encode(), model).argmax()] == r["lang"] for r in rest])
    assert right > 0.95
    odd = spark.createDataFrame([(0, None, None), (1, "http://x.de/", ""), (2, "http://x.de/", '<html lang="de"><p>und die der das</p>'), (2, "http://x.de/", "<p>...")], "page_id long, url string, html string")
    assert langid.identify(odd, langs, model).count() == 4
    assert langid.identify(odd.limit(0), langs, model).count() == 0
    assert langid.identify(odd, [], model).where("lang is null").count() == 4


def test_all_labelled_languages(spark):
    labels = [f"x{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(70)] + ["deu"]
    rows = [(k * 100 + j, f"{x} " * 20, x) for k, x in enumerate(labels) for j in range(3)]
    langs, model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows=30)
    assert langs == sorted(labels) and len(model) == 71
    declared = ["de-DE", "deu", "ger", "xaa", "xaab", "xa", "XCR"]
    pages = [(i, f"http://h{i}.x/", f'<html lang="{c}"><p>{langs[0]} {langs[0]}') for i, c in enumerate(declared)] + [(7, "http://h.x/", "<p>a")]
    got = {r["page_id"]: r["declared"] for r in langid.identify(spark.createDataFrame(pages, "page_id long, url string, html string"), langs, model).collect()}
    assert [got[i] for i in range(8)] == ["deu", "deu", "deu", "xaa", "other", "other", "xcr", "none"]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as p

    clean = lambda i: " ".join(f"{a}{b}{i}q" for a in "abcdefgh" for b in "klmnopqr")
    leak = " ".join(f"leak{k}" for k in range(10))
    other = " ".join(f"more{k}" for k in range(10))
    texts = [clean(0), clean(0) + " tail", clean(1) + " " + leak, clean(2) + " " + leak + " x " + other, clean(3) + ' token = "' + "ab12" * 10 + '"', "short", None]
    docs(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, leak), (1, other)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got, d = {}, docs(spark, texts)
    for name, stage in p.STAGES:
        d = stage(spark, d, str(tmp_path))
        got[name] = d.collect()
        assert name == "tokenize" or d.columns == docs(spark, []).columns
    ids = {k: {r["doc_id"] for r in v} for k, v in got.items()}
    assert ids["quality"] == {0, 1, 2, 3, 4} and ids["near_duplicates"] == {0, 2, 3, 4} and ids["decontaminate"] == ids["tokenize"] == {0, 2, 4}
    text = {r["doc_id"]: r for r in got["mask_secrets"]}
    assert "leak" not in text[2]["text"] and text[0]["text"] == texts[0] and "ab12" not in text[4]["text"] and text[4]["n_chars"] == len(text[4]["text"])
    assert sorted(p.run(spark, str(tmp_path)).collect()) == sorted(got["tokenize"])


def test_extra_columns(spark):
    d = docs(spark, ["a b c d e f g h", "a b c d e f g h"])
    for c in ("id", "key", "node", "n", "th", "hit", "items", "h", "r", "w", "s", "at"):
        d = d.withColumn(c, F.lit(1))
    bench = spark.createDataFrame([(1, "a b c d e f g h", 5)], "item_id long, text string, fp int")
    assert nearjoin.keep_one(d).columns == d.columns and nearjoin.keep_one(d).count() == 1
    assert decontam.clean(d, bench).columns == d.columns and decontam.contaminated(d, bench).count() == 2
    assert sharding.shard(d).count() == quality.rule_stats(d).count() == secretscan.redact(d).count() == pieces.encode_texts(d).count() == tokencount.count_tokens(d).count() == 2


def test_guess_costs_against_every_segmentation():
    """Brute force: the cheapest of all ways to cut a value, with each segment's cost stated on its own."""
    import functools
    import math

    rank = {"pass": 1, "word": 2, "in": 3, "ab": 4}
    rows, shifted = secretscan.KEY_ROWS, secretscan.SHIFTED
    place = {c: (r, k) for r, row in enumerate(rows) for k, c in enumerate(row)} | {c: (0, k) for k, c in enumerate(shifted)}

    def costs(value, i, j):
        x, low = value[i:j], value[i:j].lower()
        if len(x) == 1:
            yield secretscan._brute_bits(x), False
        if len(x) > 1 and low in rank:
            yield math.log2(rank[low]) + (x != low), True
        if re.fullmatch(r"(?:[01]?\d|2[0-3]):[0-5]\d(?::[0-5]\d)?", x):
            yield math.log2(86400 if len(x) > 5 else 1440), True
        if re.fullmatch(r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?", x):
            yield math.log2(200 * (12 if len(x) > 4 else 1) * (31 if len(x) > 7 else 1)), True
        if len(x) >= 3 and len(set(x)) == 1 and (i == 0 or value[i - 1] != x[0]):
            yield secretscan._brute_bits(x[0]) + math.log2(len(x)), True
        if len(x) >= 2 and value[max(0, i - len(x)) : i] == x:
            yield 1.0, False
        step = lambda a, b: (place[b][0] - place[a][0], place[b][1] - place[a][1]) if a in place and b in place else None
        near = {(0, 1), (0, -1), (1, 0), (1, -1), (-1, 0), (-1, 1)}
        ways = [step(a, b) for a, b in zip(low, low[1:])]
        if len(x) >= 3 and set(ways) <= near and (i == 0 or step(value[i - 1].lower(), low[0]) not in near):
            yield math.log2(47) + math.log2(len(x)) + 2 * sum(a != b for a, b in zip(ways, ways[1:])), True

    def least(value):
        @functools.cache
        def best(j):
            return 0.0 if j == 0 else min(best(i) + c + (apart and i > 0) for i in range(j) for c, apart in costs(value, i, j))

        return best(len(value))

    rnd = random.Random(12)
    values = ["password", "abcdefghiabcdefghi", "1qaz2wsx", "!@#$%", "aaaa1999-12-31", "12:30:45", "Passin2020", "qwerfvgt"]
    values += ["".join(rnd.choices(["pass", "word", "In", "ab", "1", "q", "w", "a", "aaa", "2019", "!", "Z", "12:30", "x9"], k=rnd.randrange(1, 7))) for _ in range(200)]
    for v in values:
        assert abs(secretscan.guess_bits(v, words=(rank, 4)) - least(v)) < 1e-9, v
    assert secretscan.guess_bits("abcdefghiabcdefghi") < secretscan.guess_bits("abcdefghi") + 2 and secretscan.guess_bits("1qaz") < 14


def test_fusion_against_brute_force(spark):
    """Priors, declarations and texts of few pages, fused by plain loops."""
    import math
    from collections import defaultdict

    langs, model = langid.train(spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate([("aaa aab aba", "de"), ("bbb bba bab", "fr"), ("ccc cab bca", "en")] * 3)], "doc_id long, text string, lang string"))
    rnd = random.Random(5)
    rows = [(i, f"http://{rnd.choice(['a.x.de', 'b.x.de', 'c.org', 'd.e.fr'])}/{i}", f"<html{rnd.choice(['', ' lang=de', ' lang=fr', ' lang=xx'])}><p>{' '.join(rnd.choices(['aaa', 'aba', 'bbb', 'cab'], k=rnd.randrange(4)))}") for i in range(60)]
    rows += [(60, None, None), (61, rows[0][1], rows[0][2]), (61, rows[0][1], rows[0][2])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {(r["page_id"], r["host"]): (r["lang"], r["declared"], round(r["confidence"], 6)) for r in langid.identify(pages, langs, model).collect()}
    p, said, host = [], [], []
    for _, url, html in rows:
        x = langid.likelihoods(langid.visible((html or "").encode()), model)
        e = [math.exp(v - max(x)) for v in x]
        p.append([v / sum(e) for v in e])
        d = (re.search("lang=(..)", html or "") or [None, "none"])[1]
        said.append(d if d in (*langs, "none") else "other")
        host.append(re.sub("^[^:]*://|/.*$", "", url or ""))
    def level(k):
        sums = defaultdict(lambda: [0.0] * len(langs))
        for h, x in zip(host, p):
            sums[k(h)] = [a + b for a, b in zip(sums[k(h)], x)]
        return lambda i: [max(a - b, 0.0) for a, b in zip(sums[k(host[i])], p[i])]
    suffix, domain = lambda h: h.split(".")[-1], lambda h: ".".join(h.split(".")[-2:])
    levels = [level(lambda h: 0), level(suffix), level(lambda h: (domain(h), suffix(h))), level(lambda h: h)]
    joint = {d: [sum(x[k] for x, s in zip(p, said) if s == d) for k in range(len(langs))] for d in set(said)}
    every = [sum(x[k] for x in joint.values()) for k in range(len(langs))]
    for i, r in enumerate(rows):
        prior = [1 / len(langs)] * len(langs)
        for c in levels:
            own = c(i)
            prior = [(a + langid.SMOOTHING * b) / (sum(own) + langid.SMOOTHING) for a, b in zip(own, prior)]
        z = [math.log(p[i][k] + 1e-300) + math.log(prior[k] + 1e-12) + math.log((joint[said[i]][k] + 0.5) / (every[k] + 0.5 * (len(joint) + 1))) for k in range(len(langs))]
        e = [math.exp(x - max(z)) for x in z]
        assert got[r[0], host[i]] == (langs[z.index(max(z))], said[i], round(max(e) / sum(e), 6))


def test_long_words_are_counted_without_nodes():
    scores = {"a": -1.0, "ab": -1.5, "aba": -1.7, "b": -3.0, pieces.MARK: -2.0}
    short, long = tokencount.PieceTrie(scores, -9.0), tokencount.PieceTrie(scores, -9.0)
    for w in ("abaab" * 30, "ba" * 77, "xéab" * 20, "a"):
        assert long.rolled(pieces.MARK + w) == short.insert(w.encode())
    assert long.made == 0 and long.insert(b"ab" * tokencount.LONG) == 1 + tokencount.LONG * 2 // 4 * 2 or long.made == 0


def test_groups_are_dealt_to_the_least_shard():
    to, room = sharding.dealt([("a", 5), ("b", 9), ("c", 5), ("d", 1)], 2)
    assert to == {"b": 0, "a": 1, "c": 1, "d": 0} and room == [10, 10]


def test_equal_texts_share_a_shard(spark):
    rnd = random.Random(3)
    texts = [t for k in range(60) for t in [f"{k} " + "y" * rnd.randrange(400)] * rnd.choice([1, 2, 9])] + ["z" * 900] * 12
    where = {}
    for r in sharding.shard(docs(spark, texts), ranges=16, sample=256).collect():
        where.setdefault(texts[r["doc_id"]], set()).add(r["shard"])
    total = sum(len(t) + 1 for t in texts)
    assert all(len(s) == 1 for t, s in where.items() if texts.count(t) * (len(t) + 1) * 16 <= total)


def test_extra_columns_of_other_operators(spark):
    d = docs(spark, ["a b c d e f g h", None]).withColumn("page_id", F.col("doc_id")).withColumn("url", F.lit("http://x.de/a")).withColumn("html", F.col("text"))
    for c in ("id", "key", "host", "path", "rule", "verdict", "declared", "domain", "suffix", "sha", "top", "again", "p", "h", "spans", "found", "parts"):
        d = d.withColumn(c, F.lit(1))
    langs, model = langid.train(d)
    assert langid.identify(d, langs, model).count() == urlfilter.judge(d).count() == secretscan.find_secrets(d).count() == 2
    assert quality.keep_good(d).columns == d.columns
    assert warc.merge_index(warc.read_runs(spark, warc.write_warc(d, shared_dir(spark, "test-warc")))).count() == 2
    bench = spark.createDataFrame([(1, "a b c d e f g h")], "item_id long, text string")
    assert decontam.clean(d, bench).columns == d.columns
    assert set(nearjoin.linked(d.select(F.col("doc_id").alias("n"), "text"), "n").columns) == {"n", "th", "n_", "component_id"}


def test_history_of_captures_is_in_time_order(spark):
    rows = [(i % 7, f"http://h.example/{i % 3}", f"<p>{i % 4}", f"2020-01-{1 + (i * 11) % 28:02d} 00:00:00") for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, at string").withColumn("at", F.to_timestamp("at")).repartition(4)
    got = warc.merge_index(warc.read_runs(spark, warc.write_warc(df, shared_dir(spark, "test-warc"), ts_col="at")), rows_per_range=7).collect()
    assert len(got) == 60 and [warc.order_of(tuple(r)) for r in got] == sorted(warc.order_of(tuple(r)) for r in got) and len({r["ts"] for r in got}) > 20


def test_word_pattern(spark):
    """The pattern for words takes just the characters that its contract names, case aside."""
    texts = ["".join(map(chr, range(at, at + 0x800))) for at in [*range(0, 0xD800, 0x800), 0xE000, 0xF800, 0x10000, 0x1F400, 0x10F800]]
    d = docs(spark, texts).select(decontam.words(F.col("text")).alias("w"), F.regexp_count("text", F.lit(decontam.CASED + "+")).alias("n"), "doc_id")
    lower = str.maketrans(decontam.UPPER, decontam.LOWER)
    for r in d.collect():
        want = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", texts[r["doc_id"]].translate(lower))
        assert (list(r["w"]), r["n"]) == (want, len(want))
