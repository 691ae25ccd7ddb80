"""Each operator against a brute-force version on rows with nulls, empty and repeated texts, ties and odd bytes."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import decontamination, lines, lm_scoring, near, packing, phrases, quality, secrets, toxicity, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text, lower=False):
    text = text or ""
    return WORD.findall(text.translate({c: c + 32 for c in range(65, 91)}) if lower else text)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)] + ["The", "thé", "a.", "ÿ"]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = make(60)
    out = [None, "", " \n\t", "one", "one two", "ONE two", "x y z", "a " * 200, "x" * 5000]
    out += [make(rng.randrange(30, 200)) for _ in range(20)]
    out += [f"{make(40)} {passage} {make(30)}" for _ in range(3)] + [out[-1], out[-1], passage]
    base = make(300).split()
    for _ in range(6):
        copy = list(base)
        copy[rng.randrange(300)] = "edited"
        out.append(" ".join(copy))
    return list(enumerate(out)) + [(3, "one"), (None, "a row without an id"), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"s{n % 3}", 0, 1.0) for n, (i, t) in enumerate(texts)], "doc_id long, text string, lang string, source string, n_words int, score double")


def test_phrases(docs, texts):
    count = Counter(tuple(w[k : k + 35]) for _, t in texts for w in [words(t)] for k in range(len(w) - 34))
    want = []
    for i, t in texts:
        w = words(t)
        gone = set()
        for k in range(len(w) - 34):
            if count[tuple(w[k : k + 35])] > 1:
                gone |= set(range(k, k + 35))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    found = phrases.drop_repeated_phrases(docs, with_text=False).collect()
    assert Counter(map(tuple, found)) == Counter(want) and sum(x[2] for x in want)


@pytest.mark.parametrize("few, shard_bytes", [(0, 1 << 20), (10**9, 300)])
def test_phrases_of_hot_anchors_and_in_small_shards(docs, few, shard_bytes):
    """What is counted by hash and what automata find are the same, whichever way an anchor goes."""
    plain = phrases.drop_repeated_phrases(docs, with_text=False).collect()
    other = phrases.drop_repeated_phrases(docs, with_text=False, few=few, shard_bytes=shard_bytes).collect()
    assert Counter(map(tuple, other)) == Counter(map(tuple, plain))
    assert phrases.drop_repeated_phrases(docs.where("false"), few=few).count() == 0


def test_automata_locate_what_recurs():
    """Both occurrences are found, also that which came before anything was known; with the automaton left out neither is."""
    rng = random.Random(6)
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    shared = text(50)
    rows = [(n, 0, 10 * n, " ".join(t).encode()) for n, t in enumerate([text(20) + shared + text(9), text(60), text(3) + shared[5:45] + text(8), text(34)])]

    def located(rows, most=1 << 20):
        return sorted({(b["key"], n) for part in phrases._located(rows, 35, most) for b in part.to_pylist() for n in range(b["first"], b["last"])})

    want = [(0, n) for n in range(25, 65)] + [(2, n) for n in range(23, 63)]
    assert located(rows) == want
    assert located(rows, 100) == want  # a shard that is too large is cut by further anchors
    assert located(rows, 1) == want  # what can't be cut is done as a whole
    same = [(n, 0, 0, " ".join(shared).encode()) for n in range(30)]
    assert located(same, 2000) == [(n, k) for n in range(30) for k in range(50)]

    class NoAutomaton(phrases.Passages):
        def compile(self):
            super().compile()
            self.automaton = type("Blind", (), {"iter": lambda self, line: iter(())})()

    whole = phrases.Passages
    try:
        phrases.Passages = NoAutomaton
        assert not located(rows)
    finally:
        phrases.Passages = whole


def test_near_duplicates(docs, texts):
    sets = defaultdict(list)
    for i, t in texts:
        w = words(t, lower=True)
        sets[i].append(frozenset(zip(w, w[1:], w[2:])) if len(w) > 2 else frozenset([tuple(w)] if w else []))
    ids = [i for i in sets if i is not None]
    root = {i: i for i in ids}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in ids:
        for b in ids:
            x, y = sets[a][0], sets[b][0]
            if a < b and x and y and 100 * len(x & y) >= 85 * len(x | y):
                root[max(find(a), find(b))] = min(find(a), find(b))
    for row in near.near_components(docs).collect():
        if row["doc_id"] is None:
            assert row["component_id"] is None and row["kept"]
        else:
            assert (row["n_shingles"], row["component_id"], row["kept"]) == (len(sets[row["doc_id"]][0]), find(row["doc_id"]), find(row["doc_id"]) == row["doc_id"])


@pytest.mark.parametrize("kind", ["long", "string"])
def test_different_texts_of_one_id_are_one_document(spark, kind):
    base = [f"b{i}" for i in range(60)]
    rows = [(1, " ".join(base)), (1, "another text altogether here"), (2, " ".join(base + ["more"])), (3, "another text altogether here"), (4, "alone with these words"), (5, None), (None, " ".join(base))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr(f"cast(doc_id as {kind}) as doc_id", "text")
    found = {(str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in near.near_components(docs).collect()}
    assert found == {("1", "1", True), ("2", "1", False), ("3", "1", False), ("4", "4", True), ("5", "5", True), ("None", "None", True)}
    assert near.near_components(docs.where("false")).count() == 0
    left = near.drop_near_duplicates(spark, docs.withColumn("rank_", docs["text"]), "").collect()
    assert sorted(str(r["doc_id"]) for r in left) == ["1", "4", "5", "None"]


def test_neighbours_by_common_prefix_and_adaptive_depth():
    rng = np.random.default_rng(3)
    values = np.unique(rng.integers(0, 3, (400, 6)).astype(">u4"), axis=0)
    region = np.zeros(len(values), dtype=np.int64)
    got = set(zip(*(x.tolist() for x in near.adaptive_pairs(region, values)), strict=True))
    want = {(i, i + k) for i in range(len(values)) for k in (1, 2) if i + k < len(values)}

    def descend(at, depth):
        if 2 <= len(at) <= near.SMALL:
            want.update((i, j) for i in at for j in at if i < j)
        elif len(at) > near.SMALL and depth < values.shape[1]:
            for v in np.unique(values[at, depth]):
                descend([i for i in at if values[i, depth] == v], depth + 1)

    descend(list(range(len(values))), 0)
    assert got == want


def test_twins_in_a_dense_family(spark):
    """Thousands of texts of one template, each just below the threshold to all others but its twin, if it has one."""
    rng = random.Random(8)
    base = [f"t{i}" for i in range(100)]
    rows = []
    for n in range(2400):
        at = rng.randrange(94)
        rows.append(base[:at] + [f"own{n}x{i}" for i in range(6)] + base[at + 6 :])
    for n in range(200):
        at = rng.randrange(94)
        rows.append(rows[n][:at] + [f"twin{n}x{i}" for i in range(5)] + rows[n][at + 5 :])
    docs = spark.createDataFrame([(n, " ".join(r)) for n, r in enumerate(rows)], "doc_id long, text string")
    sets = [set(zip(r, r[1:], r[2:])) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        return x if root[x] == x else find(root[x])

    for a, x in enumerate(sets):
        for b in range(a + 1, len(sets)):
            both = len(x & sets[b])
            if 100 * both >= 85 * (len(x) + len(sets[b]) - both):
                root[max(find(a), find(b))] = min(find(a), find(b))
    found = {r["doc_id"]: r["component_id"] for r in near.near_components(docs).collect()}
    assert found == {n: find(n) for n in range(len(rows))} and len(set(found.values())) < len(rows) - 100


def test_a_family_below_the_threshold_is_not_compared_in_full(spark):
    """Of 400 texts with four edits each nearly all pairs stay under the threshold; every pair that reaches it is listed, and of all others under one in 25."""
    rng = random.Random(9)
    base = [f"t{i}" for i in range(200)]
    rows = []
    for n in range(400):
        row = list(rows[rng.randrange(n)] if n % 10 == 9 else base)
        for at in rng.sample(range(200), 1 if n % 10 == 9 else 4):
            row[at] = f"own{n}x{at}"
        rows.append(row)
    sets = [set(zip(r, r[1:], r[2:])) for r in rows]
    want = {(a, b) for b in range(400) for a in range(b) for both in [len(sets[a] & sets[b])] if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both)}
    texts = spark.createDataFrame([(n, " ".join(r)) for n, r in enumerate(rows)], "node long, text string")
    pairs = near._exact_pairs(texts.select("node", texts["node"].alias("c")), texts, 3, 85)
    found = {(r["a"], r["b"]) for r in pairs.collect()}
    assert want and want <= found and len(found) < len(rows) * (len(rows) - 1) / 2 / 25


@pytest.mark.parametrize("percent", [50, 85])
def test_sketches_never_exceed_the_difference(percent):
    """Bits in which two sketches differ are no more than the shingles in which their texts do."""
    rng = random.Random(percent)
    base = [f"t{i}" for i in range(120)]
    rows = [" ".join(f"e{rng.random()}" if rng.random() < 0.04 else w for w in base[: rng.randrange(1, 121)]) for _ in range(60)] + [""]
    grams, bounds = near.shingle_sets(*near._text.utf8(near.pa.array(rows)), 3)
    bits = near.parities(grams, np.repeat(np.arange(len(rows)), np.diff(bounds)), len(rows)).view(np.uint64)
    for a in range(len(rows)):
        for b in range(a):
            x, y = (set(grams[bounds[n] : bounds[n + 1]].tolist()) for n in (a, b))
            unlike = int(np.bitwise_count(bits[a] ^ bits[b]).sum())
            assert unlike <= len(x ^ y) and (unlike - len(x ^ y)) % 2 == 0


@pytest.mark.parametrize("percent", [50, 85])
def test_few_pairs_below_the_threshold_meet_as_whole_texts(spark, monkeypatch, percent):
    """Of all pairs of a family of many lengths, those that go on to be confirmed are all that reach the threshold and few others."""
    rng = random.Random(percent)
    base = [f"t{i}" for i in range(700)]
    rows = [" ".join(f"e{rng.random()}" if rng.random() < edits else w for w in base[: rng.choice([1, 2, 3, 40, 150, 300, 560, 640, 700])]) for edits in (0, 0.01, 0.03, 0.1, 0.2) for _ in range(30)]
    sets = [{tuple(r.split()[i : i + 3]) for i in range(max(1, len(r.split()) - 2))} for r in rows]
    grams, bounds = near.shingle_sets(*near._text.utf8(near.pa.array(rows)), 3)
    assert np.diff(bounds).tolist() == [len(x) for x in sets]
    ends = [(a, b) for b in range(len(rows)) for a in range(b)]
    want = {(a, b) for a, b in ends for both in [len(sets[a] & sets[b])] if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both)}
    texts = spark.createDataFrame(list(enumerate(rows)), "node long, text string").mapInArrow(near._sketched(3), "node long, text string, n long, sketch binary")
    pairs = spark.createDataFrame(ends, "a long, b long")
    assert {tuple(r) for r in near._confirmed(pairs, texts, 3, percent, "links").collect()} == want
    monkeypatch.setattr(near, "_confirm", lambda k, percent: lambda batches: (b.select(["a", "b"]) for b in batches))
    found = {tuple(r) for r in near._confirmed(pairs, texts, 3, percent, "possible").collect()}
    assert want <= found and len(found - want) < len(ends) / 25


def test_signatures_are_the_least_hashes():
    """Those of parts of sets that are worked on together are those of each set alone."""
    rng = np.random.default_rng(3)
    sizes = [0, 1, 5, 0, near.BLOCK + 7, 3, near.BLOCK // 2, near.BLOCK // 2, 9, 0]
    bounds = np.append(0, np.cumsum(sizes))
    grams = rng.integers(0, 2**64, bounds[-1], dtype=np.uint64)
    found = near.minima(grams, bounds)
    for n, size in enumerate(sizes):
        mine = grams[bounds[n] : bounds[n + 1]]
        want = [int(((mine * f + a) >> np.uint64(32)).min()) if size else 0 for f, a in zip(near._FACTOR, near._ADDEND)]
        assert found[n].tolist() == want


def test_components_of_a_path(spark):
    found = near.components(spark.createDataFrame([(i, i + 1) for i in range(30)], "a long, b long")).collect()
    assert {r["id"] for r in found} == set(range(31)) and {r["component"] for r in found} == {0}


def test_quality(docs, texts):
    rows = {}
    for i, t in texts:
        t = t or ""
        w = words(t)
        count = Counter(zip(w, w[1:], w[2:]))
        again = {p for k in range(len(w) - 2) if count[tuple(w[k : k + 3])] > 1 for p in (k, k + 1, k + 2)}
        full = [x for x in t.split("\n") if WORD.search(x)]
        rows[i, len(w)] = (sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(full) - len(set(full)), len(again), len(w) < 50 or 100 * len(again) > 50 * len(w))
    for r in quality.quality_verdicts(docs).collect():
        assert rows[r["doc_id"], r["n_words"]] == (r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])
        assert not (r["base_failed"] and r["kept"])


def test_host_verdicts(spark):
    rng = random.Random(9)
    rows = []
    for h in range(12):
        for n in range(rng.randrange(3, 30)):
            body = [f"word{rng.randrange(500)}" for _ in range(70)]
            if rng.random() < h / 12:
                body = [w if k % 4 else "#" for k, w in enumerate(body)]
            rows.append((len(rows), None if h == 11 else f"h{h}", " ".join(body)))
    judged = quality.quality_verdicts(spark.createDataFrame([(*r, 1, 1) for r in rows], "doc_id long, source string, text string, host int, n_words int")).collect()
    hosts, bad = defaultdict(list), set()
    for r in judged:
        hosts[r["host"]].append(r)
    for rule in quality.RULES:
        n, k = {h: len(v) for h, v in hosts.items()}, {h: sum(r[rule] for r in v) for h, v in hosts.items()}
        mean, share = sum(k.values()) / sum(n.values()), [k[h] / n[h] for h in hosts]
        between = max(np.var(share) - mean * (1 - mean) * np.mean([1 / n[h] for h in hosts]), 1e-6)
        strength = max(mean * (1 - mean) / between - 1, 1.0)
        bad |= {h for h in hosts if (k[h] + mean * strength) / (n[h] + strength) > quality.MAX_RATE}
    assert bad and len(bad) < len(hosts) and len(judged) == len(rows)
    assert all(r["kept"] == (not r["base_failed"] and r["host"] not in bad) for r in judged)
    assert quality.quality_verdicts(spark.createDataFrame([], "doc_id long, source string, text string")).count() == 0


def test_url_shards(spark, monkeypatch):
    rows = spark.range(20_000).selectExpr("id", "concat('k', id % 15000) as key")
    listed = spark.range(0, 30_000, 37).selectExpr("concat('k', id) as key").union(spark.sql("select cast(null as string) as key"))
    for limit in (urls.MAX_BYTES, 400):
        monkeypatch.setattr(urls, "MAX_BYTES", limit)
        assert (urls.build_cascade(rows, listed).shards > 1) == (limit == 400)
        found = urls.flag_listed(rows, listed)
        assert found.count() == 20_000 and found.where("listed <> (cast(substr(key, 2) as int) % 37 = 0)").isEmpty()


def test_urls(spark):
    rows = [(0, None), (1, "no scheme"), (2, "http://A.Org/x?y"), (3, "https://example.org/es/1#t"), (4, "http://www.spam-farm.net/de/"), (5, "http://b.com/de/1"), (6, "http://borg/"), (7, "http://x.net"), (7, "http://x.net")]
    rows += [(100 + n, f"http://{'spam-farm' if n % 7 == 0 else f'h{n}'}.net/p{n}") for n in range(400)]
    found = {r["page_id"]: r for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert (found[0]["host"], found[0]["path"], found[0]["rule"], found[0]["verdict"]) == ("", "", None, "allow")
    assert (found[2]["host"], found[2]["rule"]) == ("a.org", "org/")
    assert found[3]["verdict"] == "block" and found[4]["verdict"] == "block" and found[5]["rule"] == "com/de/" and found[6]["rule"] is None
    assert all((found[100 + n]["verdict"] == "block") == (n % 7 == 0) for n in range(400))
    assert urls.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_secret_ledger_grows_by_unseen_blobs_only(spark, tmp_path):
    path = str(tmp_path / "ledger")
    first = spark.createDataFrame([("a", 'Password: "abcdefgh1"'), ("b", 'Password: "abcdefgh1"'), ("c", None), ("d", "é AKIA" + "X" * 12 + " " + "0f" * 16)], "path string, text string")
    rows = {r["path"]: r for r in secrets.scan_secrets(first, path).collect()}
    assert rows["a"]["spans"] == rows["b"]["spans"] == "assign:0:20" and rows["d"]["spans"] == "access:2:18,hex:19:51"
    assert rows["c"]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert secrets.read_ledger(spark, path).count() == 3
    secrets.scan_secrets(first.union(spark.createDataFrame([("e", "new")], "path string, text string")), path)
    assert secrets.read_ledger(spark, path).count() == 4
    secrets.scan_secrets(first, path, "next")
    assert secrets.read_ledger(spark, path).count() == 7


@pytest.mark.parametrize("files", [1, 6])
def test_repeated_rows_are_one_blob(spark, tmp_path, files):
    """However often a row comes again, its text is scanned once; with few new blobs too, where a filter comes first."""
    path, kind = str(tmp_path / "ledger"), "path string, text string"
    rows = [(None, "token=abcdefgh")] * 40 + [("x", "other")]
    found = secrets.scan_secrets(spark.createDataFrame(rows, kind).repartition(files), path).collect()
    assert len(found) == 41 and sum(r["n_assign"] for r in found) == 40
    assert secrets.read_ledger(spark, path).count() == 2
    rows += [(None, "secret: 123456789")] * 5
    found = secrets.scan_secrets(spark.createDataFrame(rows, kind).repartition(files), path).collect()
    assert len(found) == 46 and sum(r["n_assign"] for r in found) == 45
    assert secrets.read_ledger(spark, path).count() == 3


def test_secrets_against_brute_force(spark, tmp_path):
    """By the letter: runs of characters, one after another, without the operator's patterns."""
    rng = random.Random(12)
    names = ["password", "passwd", "secret", "token", "api_key", "apikey", "API_Key", "PASSWORD"]
    value = "ABCabc019+/_.=-"

    def base(text):
        found, at = [], 0
        while at < len(text):  # assignments
            name = next((n for n in ("password", "passwd", "secret", "token", "api_key", "apikey") if text[at : at + len(n)].lower() == n and text[at : at + len(n)].isascii()), None)
            k = at + len(name) if name else 0
            if not name:
                at += 1
                continue
            k += text[k : k + 1] in ('"', "'") and bool(text[k : k + 1])
            while text[k : k + 1] == " ":
                k += 1
            if text[k : k + 1] not in (":", "=") or not text[k : k + 1]:
                at += 1
                continue
            k += 1
            while text[k : k + 1] == " ":
                k += 1
            k += text[k : k + 1] in ('"', "'") and bool(text[k : k + 1])
            end = k
            while end < len(text) and (text[end].isascii() and text[end].isalnum() or text[end] in "+/_.=-"):
                end += 1
            if end == k:
                at += 1
                continue
            if end - k >= 8:
                found.append((at, 0, f"assign:{at}:{end}"))
            at = end
        for rank, kind, start, letters, least in ((1, "access", "AKIA", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 16), (2, "hex", "", "0123456789abcdef", 32)):
            at = 0
            while at < len(text):
                end = at + len(start)
                if text[at:end] != start:
                    at += 1
                    continue
                while end < len(text) and text[end] in letters:
                    end += 1
                if end == at + len(start):
                    at += 1
                    continue
                if end - at >= least:
                    found.append((at, rank, f"{kind}:{at}:{end}"))
                at = end
        return sorted(found)

    def piece():
        n = rng.randrange(4, 40)
        return rng.choice([
            f"{rng.choice(names)}{rng.choice(['', chr(34), chr(39)])}{' ' * rng.randrange(3)}{rng.choice(':=')}{' ' * rng.randrange(3)}{rng.choice(['', chr(34)])}{''.join(rng.choice(value) for _ in range(n))}",
            "AKIA" + "".join(rng.choice("AKI09Z") for _ in range(n)), "".join(rng.choice("0123456789abcdef") for _ in range(n)), "é ", " plain words ", "token", "\n",
        ])

    texts_ = ["".join(piece() for _ in range(rng.randrange(12))) for _ in range(400)] + [None, ""]
    rows = list(enumerate(texts_)) + [(3, texts_[3]), (None, texts_[4])]
    path = str(tmp_path / "blobs")
    half = spark.createDataFrame(rows[:390], "path long, text string")
    secrets.scan_secrets(half, path).count()
    before = secrets.read_ledger(spark, path).count()
    found = secrets.scan_secrets(spark.createDataFrame(rows, "path long, text string"), path).collect()
    assert before == len({t or "" for _, t in rows[:390]}) and secrets.read_ledger(spark, path).count() == len({t or "" for _, t in rows})
    want = Counter()
    for i, t in rows:
        spans = base(t or "")
        want[i, *(sum(r == k for _, r, _ in spans) for k in range(3)), hashlib.sha256(",".join(x for *_, x in spans).encode()).hexdigest()] += 1
    assert Counter((r["path"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in found) == want
    assert secrets.scan_secrets(half.where("false"), str(tmp_path / "none")).count() == 0


def test_scores(docs, texts):
    from pyspark.sql import functions as F

    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 == 2
    count = Counter(w for i, t in texts if not held(i) for w in [*words(t, True), None])
    n, v = sum(count.values()), len(count)
    want = Counter()
    for i, t in texts:
        w = [*words(t, True), None]
        want[i, len(w), sum(x in count for x in w), n, round(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), 6)] += 1
    found = lm_scoring.score_texts(docs, ~lm_scoring.held_out(F.col("doc_id"))).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in found) == want
    assert all(r["score"] < 0 for r in found)


@pytest.mark.parametrize("rows_, entries", [(1 << 16, 1 << 22), (8, 40)])
def test_model_against_brute_force(spark, rows_, entries):
    """The score by its definition, symbol by symbol; with small bounds most contexts come from tables."""
    from pyspark.sql import functions as F

    rng = random.Random(17)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 5)))
    text = lambda n: " ".join(word() for _ in range(n))
    texts_ = [text(rng.randrange(1, 120)) for _ in range(40)]
    texts_ += [texts_[0], texts_[1] + " and more", texts_[2][:200] + text(20), "", None, "x" * 300, "zzz"]
    rows = list(enumerate(texts_))
    spelled = lambda t: [*(t or "").encode(), 255]
    orders = [defaultdict(Counter) for _ in range(4)]
    deep = defaultdict(Counter)

    def parts(seq):
        cuts = [0]
        for i in range(lm_scoring.DEEP, len(seq)):
            last = int.from_bytes(bytes(seq[i - 4 : i]), "big")
            if ((last * 2654435761) % 2**32 >> 16) % lm_scoring.SPACING == 0:
                cuts.append(i)
        return [(i, tuple(seq[i - lm_scoring.DEEP : i]) if i else None, tuple(seq[i:j])) for i, j in zip(cuts, [*cuts[1:], len(seq)])]

    for i, t in rows:
        if i % 3:
            seq = spelled(t)
            for k, s in enumerate(seq):
                past = [255, 255, 255, *seq[:k]]
                for order in range(4):
                    orders[order][tuple(past[len(past) - order :])][s] += 1
            for _, context, branch in parts(seq):
                deep[context][branch] += 1

    def low(context, s, without=frozenset()):
        """Orders 2 to 0, the symbols of longer contexts excluded."""
        seen = orders[len(context)].get(context, Counter())
        here = {x: n for x, n in seen.items() if x not in without}
        total, kinds = sum(here.values()), len(here)
        if s in here:
            return here[s] / (total + kinds)
        escape = kinds / (total + kinds) if kinds else 1.0
        if not context:
            return escape / max(1, 256 - len(seen))
        return escape * low(context[1:], s, without | set(seen))

    def short(seq, k):
        past = tuple([255, 255, 255, *seq[:k]][-3:])
        seen, s = orders[3].get(past), seq[k]
        if not seen:
            return low(past[1:], s)
        total, kinds = sum(seen.values()), len(seen)
        if s in seen:
            return seen[s] / (total + kinds)
        return kinds / (total + kinds) * low(past[1:], s) / (1 - sum(low(past[1:], x) for x in seen))

    def score(seq):
        out = 0.0
        for begin, context, branch in parts(seq):
            below = deep.get(context, Counter())
            n, k, c = sum(below.values()), len(below), below[branch]
            if c:
                out += math.log10(c / (n + k)) + (len(branch) - 1) * math.log10(c / (c + 1))
            else:
                out += math.log10(k / (n + k)) if n else 0.0
                out += sum(math.log10(short(seq, i)) for i in range(begin, begin + len(branch)))
        return out

    docs = spark.createDataFrame([(*r, 1.0, 1) for r in rows], "doc_id long, text string, score double, row int")
    found = {r["doc_id"]: r["score"] for r in lm_scoring.score_texts(docs, F.col("doc_id") % 3 != 0, rows_, entries).collect()}
    assert all(abs(found[i] - score(spelled(t))) < 1e-3 * (1 + abs(found[i])) for i, t in rows)
    empty = docs.where("false")
    assert lm_scoring.score_texts(empty, F.lit(True)).count() == 0
    assert lm_scoring.score_texts(docs, F.lit(False)).where("train_tokens = 0").count() == len(rows)


def test_lines_against_brute_force(spark):
    rng = random.Random(4)
    notice = " ".join(f"n{i}" for i in range(60))
    footer = ["All rights reserved.", "Contact us", "Terms of use"]
    rows = [(n, f"s{n % 9}", "\n".join([f"own {n} a", *footer, f" own {n} b "])) for n in range(12)] + [(100 + n, f"s{n}", f"x{n}\n{notice}") for n in range(6)]
    rows += [(200 + n, f"s{n}", "a copy\nof a page") for n in range(8)] + [(300 + n, f"s{n}", "four sites\nonly") for n in range(4)] * 2
    rows += [(400, None, None), (401, "s1", ""), (402, None, "\n \n"), (None, None, footer[0])]
    rows += [(500 + n, f"s{rng.randrange(9)}", "\n".join(f"l{rng.randrange(40)}" for _ in range(rng.randrange(8)))) for n in range(60)]
    sites = defaultdict(set)
    for _, site, text in rows:
        for line in (text or "").split("\n"):
            sites[line.strip()].add(site)
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, text string, k1_ int")

    def want(text, spare):
        if text is None:
            return None
        lines_ = text.split("\n")
        bad = [bool(x.strip()) and len(sites[x.strip()]) >= 5 for x in lines_]
        if spare and sum(len(x.strip()) for x, b in zip(lines_, bad) if b) > spare * sum(len(x.strip()) for x in lines_):
            return text
        return "\n".join(x for x, b in zip(lines_, bad) if not b)

    for spare in (None, 0.5):
        found = lines.drop_boilerplate(docs, spare=spare).collect()
        assert Counter((r["doc_id"], r["text"]) for r in found) == Counter((i, want(t, spare)) for i, _, t in rows)
        assert {r["text"] for r in found if r["doc_id"] == 200} == {"" if spare is None else "a copy\nof a page"}
    assert lines.drop_boilerplate(docs.where("false")).count() == 0


def test_packing(docs, texts):
    found = packing.pack_documents(docs, (64, 128)).collect()
    fill, tokens = Counter(), Counter()
    for r in found:
        fill[r["shard"], r["bin"], r["capacity"]] += r["n_tokens"]
        tokens[r["doc_id"]] += r["n_tokens"]
    assert all(f <= c and c in (64, 128) and (c == 64 or f > 64) for (_, _, c), f in fill.items())
    want = Counter()
    for i, t in texts:
        want[i] += -(-len((t or "").encode()) // 4) + 1
    assert tokens == want


def test_packing_is_near_the_optimum():
    def best(sizes, capacities):
        least = [10**9]

        def go(i, bins):
            cost = sum(next(c for c in capacities if c >= b) + packing.BIN_COST for b in bins)
            if cost >= least[0]:
                return
            if i == len(sizes):
                least[0] = cost
                return
            for k in {b: k for k, b in enumerate(bins) if b + sizes[i] <= capacities[-1]}.values():
                bins[k] += sizes[i]
                go(i + 1, bins)
                bins[k] -= sizes[i]
            go(i + 1, [*bins, sizes[i]])

        go(0, [])
        return least[0]

    rng, capacities, mine, optimum = random.Random(1), (32, 64, 128), 0, 0
    for _ in range(60):
        sizes = sorted((rng.randrange(1, 129) for _ in range(8)), reverse=True)
        place, fill, caps = packing.pack(sizes, capacities)
        assert fill == [sum(s for s, p in zip(sizes, place) if p == n) for n in range(len(fill))] and all(f <= c for f, c in zip(fill, caps))
        mine, optimum = mine + sum(caps) + packing.BIN_COST * len(caps), optimum + best(sizes, capacities)
    assert mine <= 1.01 * optimum
    # Bins of several lengths are opened together.
    assert packing.pack([100, 100, 60, 30], capacities)[2] == [128, 128, 64, 32]


def test_packing_keeps_ids_and_deals_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 20)
    big = 2**53
    docs = spark.createDataFrame([(big + 1, "a"), (big + 3, "b"), (None, "c")] + [(7, "same text")] * 200, "doc_id long, text string")
    found = packing.pack_documents(docs).collect()
    assert Counter(r["doc_id"] for r in found) == Counter({7: 200, big + 1: 1, big + 3: 1, None: 1})
    assert len({r["shard"] for r in found if r["doc_id"] == 7}) > 5
    assert packing.pack_documents(docs.where("false")).count() == 0
    assert {r["doc_id"] for r in packing.pack_documents(docs.selectExpr("cast(doc_id as string) as doc_id", "text")).collect()} >= {str(big + 1), None}


def test_decontamination(spark):
    rng = random.Random(3)
    vocabulary = [f"v{i}" for i in range(500)]
    item = [rng.choice(vocabulary) for _ in range(40)]
    edited = [w for k, w in enumerate(item) if k % 9 != 4]
    noise = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    rows = [(1, " ".join(noise(50) + item + noise(50)).upper()), (2, " ".join(noise(30) + edited + noise(10))), (3, " ".join(noise(300))), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(9, ", ".join(item)), (10, "too short"), (11, None)], "item_id long, text string")
    found = {r["doc_id"]: r for r in decontamination.find_copies(docs, bench).collect()}
    assert set(found) == {1, 2} and found[1]["score"] == 1 and (found[1]["first_word"], found[1]["end_word"]) == (50, 90)
    assert decontamination.find_copies(docs, bench.where("false")).count() == 0 and decontamination.find_copies(docs.where("false"), bench).count() == 0
    for kind in ("int", "string"):
        other = decontamination.find_copies(docs, bench.selectExpr(f"cast(item_id as {kind}) as item_id", "text")).collect()
        assert {(r["doc_id"], str(r["item_id"])) for r in other} == {(1, "9"), (2, "9")}


def test_edited_copies_as_by_plain_alignment(spark):
    """Words substituted, left out and put in; each pair of text and item scored by the full matrix."""

    def plain(item, text):
        row, best = [0] * (len(text) + 1), 0
        for w in item:
            new = [0]
            for k, x in enumerate(text):
                new.append(max(0, row[k] + (2 if w == x else -1), row[k + 1] - 1, new[k] - 1))
            row, best = new, max(best, *new)
        return best / (2 * len(item))

    rng = random.Random(11)
    common = [f"c{i}" for i in range(12)]
    word = lambda: rng.choice(common) if rng.random() < 0.3 else f"r{rng.randrange(3000)}"
    items = [[word() for _ in range(n)] for n in [*range(3, 16), 20, 20, 30, 38, 38, 60]]
    rows = []
    for item in items:
        for share in (0, 0.1, 0.15, 0.2, 0.25, 0.3):
            for how in "sdi":
                copy = []
                for w in item:
                    edit = rng.random() < share
                    copy += [word()] if edit and how == "s" else [] if edit and how == "d" else [w, word()] if edit else [w]
                rows.append([word() for _ in range(rng.randrange(60))] + copy + [word() for _ in range(rng.randrange(60))])
        rows.append([x for w in item for x in (w, word())])
        rows.append([word() if k % 3 == 2 else w for k, w in enumerate(item)])
    docs = spark.createDataFrame([(n, " ".join(r)) for n, r in enumerate(rows)], "doc_id long, text string")
    bench = spark.createDataFrame([(n, " ".join(i)) for n, i in enumerate(items)], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r["score"] for r in decontamination.find_copies(docs, bench).collect()}
    want = {(d, i): s for d, r in enumerate(rows) for i, item in enumerate(items) if (s := plain(item, r)) >= decontamination.MIN_SCORE}
    assert found == want


def test_toxicity(spark):
    rng = random.Random(2)
    rows = [(n, " ".join([f"w{rng.randrange(400)}" for _ in range(60)] + ["vile"] * (n % 8 == 0)), int(n % 8 == 0)) for n in range(1200)]
    docs = spark.createDataFrame([r[:2] for r in rows] + [(None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    found = toxicity.score_toxicity(docs, toxicity.train(docs, labels)).collect()
    assert all((r["score"] >= toxicity.THRESHOLD) == ("vile" in (r["text"] or "")) for r in found)
    assert toxicity.score_toxicity(docs, toxicity.train(docs, labels.where("false"))).count() == len(found)


def test_toxicity_reads_no_held_out_label(spark):
    rng = random.Random(2)
    rows = [(n, " ".join([f"w{rng.randrange(400)}" for _ in range(60)] + ["vile"] * (n % 8 == 0)), int(n % 8 == 0)) for n in range(900)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    labels = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int")
    turned = spark.createDataFrame([(i, 1 - t if held(i) else t) for i, _, t in rows], "doc_id long, toxic int")
    one, two = (toxicity.train(docs, x) for x in (labels, turned))
    assert np.array_equal(one.weights, two.weights) and (one.bias, one.slope, one.offset) == (two.bias, two.slope, two.offset)
    assert toxicity.score_toxicity(docs.where("false"), one).count() == 0


def test_risk_is_not_negative():
    z = np.array([3.0, 2.0, -4.0, -5.0, -6.0])
    step = toxicity.risk_slopes(z, 2, 0.6)  # unlabelled logits so low that the negative part is below zero
    assert (step[:2] > 0).all() and (step[2:] < 0).all()
    step = toxicity.risk_slopes(-z, 2, 0.1)
    assert (step[:2] < 0).all() and (step[2:] > 0).all()
