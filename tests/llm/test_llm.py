"""The training-data operators against brute force, and on odd inputs."""

import hashlib
import math
import os
import posixpath
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from tarnfield.llm import license_scans, mixing, quality_rules, sentencepiece_codec, sharding, simhash_dedup, suffix_dedup, token_counts, topk_search, url_filters
from tarnfield.llm.tables import drop, materialise

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
random.seed(7)
VOCAB = ["".join(random.choice("abcdefgé") for _ in range(random.randint(1, 7))) for _ in range(300)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) for _ in range(n))


@pytest.fixture(scope="module")
def odd():
    """Nulls in every column, empty and very long texts, ties, repeated rows, near copies."""
    base = prose(120, 1)
    texts = [None, "", "   \n\t ", "x", base, base, base + " tail", "a" * 5000, prose(20000, 2), "one\nline\nline\nline", "é" * 300 + "\x00" + "▁z", prose(60, 3) + base + prose(60, 4)]
    rows = [(i, t, ["en", None, "de"][i % 3], ["s1", None, "s2", "s1"][i % 4], None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, base, None, None, None), (7, prose(80, 5), "en", "s1", 1), (None, None, None, None, None)]
    return rows


@pytest.fixture(scope="module")
def frame(spark, odd):
    return spark.createDataFrame(odd, DOCS)


@pytest.fixture(scope="module")
def clashing(frame):
    """Extra columns with the names that the operators use themselves."""
    from pyspark.sql import functions as F

    names = ["size", "shard", "fp", "key", "pos", "k", "kept", "n_bytes", "spans", "copies", "v0", "m0", "group", "text_in", "piece_ids", "rank", "text_md5", "nth", "stay_id"]
    return frame.withColumns({n: F.lit("x") for n in names})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# ---- token counts


def greedy(word, pieces, longest):
    n = i = 0
    while i < len(word):
        j = next((j for j in range(min(len(word), i + longest), i, -1) if word[i:j] in pieces), i + 1)
        n, i = n + 1, j
    return n


def test_automaton_equals_greedy_matching():
    r = random.Random(3)
    pieces = {bytes(r.choice(b"abc") for _ in range(r.randint(1, 5))) for _ in range(25)} | {b"a", b"b"}
    auto = token_counts.LongestMatch(pieces)
    for _ in range(2000):
        w = bytes(r.choice(b"abcd") for _ in range(r.randint(0, 12)))
        assert auto.count(w) == greedy(w, pieces, 5), w


def test_token_counts(frame, odd, empty, clashing):
    pieces = set(token_counts.load_vocabulary())
    longest = max(map(len, pieces))
    got = token_counts.token_counts(frame).collect()
    assert len(got) == len(odd)
    expect = sorted((str(i), len(WORD.findall(t or "")), sum(greedy(b" " + w.encode(), pieces, longest) for w in WORD.findall(t or ""))) for i, t, *_ in odd)
    assert sorted((str(r.doc_id), r.n_words, r.n_tokens) for r in got) == expect
    assert token_counts.token_counts(empty).count() == 0
    assert token_counts.token_counts(clashing).count() == len(odd)


def test_token_memo_is_bounded_in_bytes(monkeypatch):
    monkeypatch.setattr(token_counts, "MEMO_BYTES", 1 << 14)
    r, memo = random.Random(3), token_counts.Memo()
    auto = token_counts.LongestMatch({bytes([b]) for b in range(256)} | {b"ab", b"abc"})
    for _ in range(60):
        words = [bytes(r.choice(b"abc") for _ in range(r.choice([4, 200, 5000]))) for _ in range(20)]
        n, tokens = token_counts.count_tokens(b" ".join(words), auto, memo)
        assert (n, tokens) == (20, sum(auto.count(b" " + w) for w in words))
        assert sum(map(len, memo)) <= (1 << 14) + 200 and max(map(len, memo)) <= 200


# ---- quality rules


def base_statistics(text):
    t = text or ""
    w = WORD.findall(t)
    lines = t.split("\n")
    dup = sum(1 for i, x in enumerate(lines) if WORD.search(x) and x in lines[:i])
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    inside = {k for i, x in enumerate(tri) if tri.count(x) > 1 for k in range(i, i + 3)} if len(tri) < 3000 else None
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, None if inside is None else len(inside)


def test_quality_base_columns(frame, odd, empty):
    got = quality_rules.quality_table(frame).collect()
    assert len(got) == len(odd)
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    for i, t, *_ in odd:
        n, chars, symbols, dup, repeat = base_statistics(t)
        r = next(r for r in by[i] if r.n_words == n and r.word_chars == chars)
        assert (r.n_symbols, r.n_dup_lines) == (symbols, dup)
        if repeat is not None:
            assert r.n_repeat_words == repeat
        assert r.base_failed == (n < 50 or 100 * r.n_repeat_words > 50 * n)
        assert not (r.kept and r.base_failed)
    assert quality_rules.quality_table(empty).count() == 0


def steps_on_one_array(x):
    """The search on one array, with its own determinants: centre and scatter before shrinking."""
    floor, n = np.diag(np.square(quality_rules.FLOORS)), len(x)
    med, sd = np.zeros(5), np.zeros(5)
    for i, (lo, hi) in enumerate(quality_rules._GRID):
        width = (hi - lo) / 1000
        cell = np.sort(np.clip(np.floor((x[:, i] - lo) / width), 0, 999))
        q = [cell[math.ceil(p * n) - 1] for p in (0.25, 0.5, 0.75)]
        med[i], sd[i] = lo + (q[1] + 0.5) * width, (q[2] - q[0]) * width / 1.349

    def square(mean, cov):
        return ((x - mean) @ np.linalg.inv(cov + floor) * (x - mean)).sum(axis=1)

    def step(mean, cov):
        b = np.floor(16 * np.log2(np.maximum(square(mean, cov), 1e-3)))
        size, left, w = np.unique(b, return_counts=True), math.ceil(0.75 * n), np.zeros(n)
        for v, c in zip(*size):
            w[b == v] = min(max(left / c, 0.0), 1.0)
            left -= c
        m = (x * w[:, None]).sum(axis=0) / w.sum()
        return m, quality_rules.consistency(0.75) * ((x - m).T * w @ (x - m)) / w.sum()

    scale = np.sqrt(sd**2 + np.diag(floor))
    z = (x - med) / scale
    starts = [(med, np.diag(sd**2))]
    for y in (np.tanh(z), z / np.maximum(np.linalg.norm(z, axis=1), 1e-9)[:, None]):
        c = np.cov(y.T, bias=True)
        r = np.sqrt(np.maximum(np.diag(c), 1e-12))
        starts.append((med, c / np.outer(r, r) * np.outer(scale, scale)))
    starts.append((x.mean(axis=0), np.cov(x.T, bias=True)))
    det = lambda e: np.linalg.slogdet(e[1] + floor)[1]
    for _ in range(quality_rules.TRIALS):
        starts = [step(*e) for e in starts]
    best = min(starts, key=det)
    for _ in range(30):
        new = step(*best)
        if det(new) >= det(best) - quality_rules.LEAST_FALL:
            break
        best = new
    near = x[square(*best) <= 12.8325]
    return near.mean(axis=0), quality_rules.consistency(0.975) * np.cov(near.T, bias=True), det(best)


def test_quality_estimate_is_robust_and_equals_single_node(spark):
    """Outliers are a fifth of the group and are rejected; distances equal those of
    the same search on one array (language and table hold the same rows, so nothing is shrunk)."""
    rows = [(i, prose(random.Random(i).randint(60, 400), i), "en", "s", 0) for i in range(160)]
    rows += [(1000 + i, " ".join(w + "###$$$" for w in prose(150, 500 + i).split()), "en", "s", 0) for i in range(40)]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r for r in quality_rules.quality_table(docs).collect()}
    assert all(got[i].kept for i in range(160))
    assert not any(got[1000 + i].kept for i in range(40))
    x = np.array([quality_rules.text_statistics(r[1].encode())[5:] for r in rows])
    mean, cov, _ = steps_on_one_array(x)
    d = np.sqrt(((x - mean) @ np.linalg.inv(cov + np.diag(np.square(quality_rules.FLOORS))) * (x - mean)).sum(axis=1))
    assert np.allclose(d, [got[r[0]].distance for r in rows], rtol=1e-3)
    again = {r.doc_id: r.distance for r in quality_rules.quality_table(docs.repartition(7)).collect()}
    assert again == {i: r.distance for i, r in got.items()}  # the order of rows changes nothing


def test_search_comes_near_the_least_determinant_of_all_subsets():
    """Twelve rows, three of them far out: the best of all 220 cores of nine."""
    from itertools import combinations

    floor = np.diag(np.square(quality_rules.FLOORS))
    for seed in range(8):
        x = np.random.default_rng(seed).normal(size=(12, 5)) * 0.2 + 0.5
        x[:3] += 3.0
        all_ = [np.linalg.slogdet(quality_rules.consistency(0.75) * np.cov(x[list(c)].T, bias=True) + floor)[1] for c in combinations(range(12), 9)]
        assert steps_on_one_array(x)[2] <= np.quantile(all_, 0.05)


def test_chi2_constants():
    assert abs(quality_rules.chi2_quantile(0.975, 5) - 12.8325) < 1e-3
    assert abs(quality_rules.consistency(0.75) - 1.412) < 2e-3


def test_quality_rejects_each_kind_of_outlier(spark):
    """Texts that pass the base rules and are odd in one variable alone."""
    rows = [(i, prose(random.Random(i).randint(60, 400), i), "en", "s", 0) for i in range(100)]
    once = list(dict.fromkeys(prose(3000, 900).split()))
    again = prose(96, 901)
    odd = {
        1000: "\n".join(f"home\nhome\n{w}" for w in once[:100]),
        1001: f"{again} {prose(208, 902)} {again}",
        1002: " | ".join(prose(3, 910 + i) for i in range(80)),
    }
    rows += [(i, t, "en", "s", 0) for i, t in odd.items()]
    got = {r.doc_id: r for r in quality_rules.quality_table(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(got[i].kept for i in range(100))
    assert got[1000].n_dup_lines > 150 and got[1000].n_repeat_words == 0
    assert got[1001].n_repeat_words >= 192 and got[1001].n_dup_lines == 0
    assert not any(got[i].base_failed or got[i].kept for i in odd)


@pytest.mark.parametrize("langs", [["en"], ["en", None, "de", "fr"]])
def test_quality_small_groups_are_judged(spark, langs):
    """One row to a source: each group's own row moves its language's estimate by a hundredth."""
    n = 36
    rows = [(i, prose(random.Random(i).randint(60, 400), i), langs[i % len(langs)], f"s{i}", 0) for i in range(n)]
    rows += [(1000 + i, " | ".join(prose(3, 910 + i + k) for k in range(80)), lang, "only", 0) for i, lang in enumerate(langs)]
    rows += [(2000, "too short", "es", None, 0)]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r for r in quality_rules.quality_table(docs).collect()}
    assert len(got) == len(rows) and all(r.distance is not None for r in got.values())
    assert all(got[i].kept for i in range(n)) and not any(got[1000 + i].kept for i in range(len(langs)))
    pooled = quality_rules.quality_table(docs.selectExpr("doc_id", "text", "'x' AS lang", "'y' AS source", "n_chars")).collect()
    assert np.median([abs(r.distance - got[r.doc_id].distance) / r.distance for r in pooled if r.doc_id < n]) < 0.3
    kept = quality_rules.keep_good(docs).collect()
    assert {r.doc_id for r in kept} == set(range(n))


@pytest.mark.parametrize("size", [5, 29, 31])
def test_quality_has_no_switch_by_size(spark, size):
    """A group of 5, 29 or 31 rows beside a large one: junk goes, clean rows stay."""
    rows = [(i, prose(random.Random(i).randint(60, 400), i), "en", "big", 0) for i in range(120)]
    rows += [(500 + i, prose(random.Random(i + 7).randint(60, 400), 500 + i), "en", "small", 0) for i in range(size - 1)]
    rows += [(999, " | ".join(prose(3, 910 + k) for k in range(80)), "en", "small", 0)]
    got = {r.doc_id: r for r in quality_rules.quality_table(spark.createDataFrame(rows, DOCS)).collect()}
    assert {i for i, r in got.items() if not r.kept} == {999}


def test_quality_stage_keeps_columns(clashing):
    out = quality_rules.keep_good(clashing)
    assert out.columns == clashing.columns
    assert {r.doc_id for r in out.collect()} <= {4, 5, 6, 7, 8, 11, None}


def test_quality_table_ignores_other_columns(frame, clashing):
    rows = lambda docs: sorted(map(str, quality_rules.quality_table(docs).collect()))
    assert rows(clashing) == rows(frame)


def test_quality_salted_join_gives_the_same(frame, monkeypatch):
    a = sorted(map(str, quality_rules.quality_table(frame).collect()))
    monkeypatch.setattr(quality_rules, "BROADCAST_GROUPS", -1)
    assert sorted(map(str, quality_rules.quality_table(frame).collect())) == a


# ---- suffix dedup


def removed_by_force(rows):
    """(key, bytes, marks of the bytes that go) of each distinct text."""
    seen = set()
    for key, text in sorted({(-(1 << 63) if i is None else i, t or "") for i, t in rows}, key=lambda r: (r[0], suffix_dedup.xxhash.xxh64_intdigest(r[1].encode()))):
        b = text.encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(b[k : k + 100])
        yield key, b, gone


def cut_by_force(rows):
    out = {}
    for key, b, gone in removed_by_force(rows):
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[key, hashlib.sha256(b).hexdigest()] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot_from", [100_000, 6, 1])
def test_suffix_dedup_equals_brute_force(spark, odd, empty, monkeypatch, hot_from):
    """Whatever anchors count as hot, the result is the same."""
    monkeypatch.setattr(suffix_dedup, "HOT_LEAST", hot_from)
    shared = prose(40, 99)
    rows = [(i, t, None, None, None) for i, t, *_ in odd] + [(100 + i, prose(30, 200 + i) + shared + prose(10 + i, 300 + i), None, None, None) for i in range(12)]
    rows += [(200, "ab" * 400, None, None, None), (201, "xx" + "ab" * 300, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3).select("doc_id", "text")
    got = suffix_dedup.remove_repeats(docs)[0].collect()
    assert bool(len(suffix_dedup.repeated_anchors(docs.na.fill(0, ["doc_id"]), "doc_id", "text", 4)[1])) == (hot_from < 100)
    expect = cut_by_force([(r[0], r[1]) for r in rows])
    assert len(got) == len(rows)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(
        (str(i), *expect[-(1 << 63) if i is None else i, hashlib.sha256((t or "").encode()).hexdigest()]) for i, t, *_ in rows)
    assert suffix_dedup.remove_repeats(empty)[0].count() == 0


def test_loser_tree_sorts_without_comparing_known_prefixes():
    r = random.Random(5)
    strings = [bytes(r.choice(b"ab") for _ in range(100)) for _ in range(200)] + [b"c" * 90 + bytes(r.choice(b"ab") for _ in range(10)) for _ in range(200)]
    runs = [sorted(strings[k::7]) for k in range(7)]
    blobs = [suffix_dedup.encode_run(x, [b""] * len(x), [(k, 0, i) for i in range(len(x))]) for k, x in enumerate(runs)]
    tree = suffix_dedup.LoserTree([suffix_dedup.decode_run(b) for b in blobs])
    out = list(tree)
    assert [o[1] for o in out] == sorted(strings)
    for a, b in zip(out, out[1:]):
        n = next((k for k in range(100) if a[1][k] != b[1][k]), 100)
        assert b[0] == n
    assert tree.compared < 40 * len(strings)  # plain comparison would look at 90 bytes and more for half of them


def test_windows_of_several_runs_are_marked_but_the_earliest():
    r = random.Random(2)
    windows = [bytes(r.choice(b"ab") for _ in range(100)) for _ in range(30)]
    contexts = [[(w, b"", (r.randrange(90), 0, i)) for i, w in enumerate(r.sample(windows, 12))] for _ in range(6)]
    runs, got = defaultdict(list), []
    for own in contexts:
        by_range, settled = suffix_dedup.window_runs(own, 3)
        got += settled
        for k, blob in by_range.items():
            runs[k].append(blob)
    for blobs in runs.values():
        got += suffix_dedup.repeated_windows(blobs)
    places = defaultdict(set)
    for own in contexts:
        for w, _, place in own:
            places[w].add(place)
    assert set(got) == {(*p, p[2] + 100) for own in places.values() for p in sorted(own)[1:]}


def test_anchors_meet_in_every_window():
    text = prose(400, 8).encode()
    _, at, _ = suffix_dedup.anchors([text, b"short", text[:150]])
    assert all(((at >= k) & (at <= k + 68)).any() for k in range(len(text) - 99))


def test_suffix_stage(clashing):
    out = suffix_dedup.cut_texts(clashing)
    assert out.columns == clashing.columns
    rows = out.collect()
    assert sum(r.text is None for r in rows) == 2
    assert len([r for r in rows if r.doc_id == 5]) == 0  # an exact copy of 4 is cut away whole


# ---- sharding


def test_sharding(spark, frame, odd, empty, clashing):
    import zlib

    got = sharding.place(clashing, 4).collect()
    assert len(got) == len(odd)
    expect = sorted((str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in odd)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == expect
    many = spark.createDataFrame([(i, prose(i % 40 + 1, i) if i % 3 else "the same text", None, None, None) for i in range(5000)], DOCS)
    got = sharding.place(many).collect()
    loads, slots = defaultdict(int), defaultdict(list)
    for r in got:
        loads[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert set(loads) == set(range(24))
    assert max(loads.values()) - min(loads.values()) < 2 * max(r.size for r in got)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.place(empty).count() == 0


# ---- urls


def test_urls_against_plain_matching(spark):
    import fnmatch

    hosts = ["a.org", "example.org", "x.example.org", "EXAMPLE.com", "mycasino.net", "ads.site.io", "org", "", "notorg"]
    paths = ["", "/", "/es/", "/es/1?x=/en/1", "/en/1", "/en/12#top", "/fr/a", "/de/", "/login", "/a/b.jpg", "/a/wp-admin/c", "/é" * 40]
    hosts += ["user@mycasino.net:8080", "ads.site.io.", "plain.net:80"]
    paths += ["/%6cogin/x", "/a/../login", "/a/./b.jp%67", "/x/..", "/%2flogin", "/img/photo.jpg.html"]
    urls = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "", "no scheme/de/", "://", "ftp://a.org/x?http://example.org/es/", "http://a.com?x", "x" * 3000 + "://a.org/" + "y" * 3000]
    got = url_filters.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()
    rules = [("example.org", "/en/1", "block"), ("example.org", "/es/", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"), ("org", "/", "allow")]
    for r in got:
        u = urls[r.page_id] or ""
        m = re.match(r"(?s).*?://([^/?#]*)(/[^?#]*)?", u)
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]) if m else ""
        path = (m[2] or "") if m else ""
        assert (r.host, r.path) == (host, path)
        hit = next((x for x in rules if (host == x[0] or host.endswith("." + x[0])) and path.startswith(x[1])), None)
        if hit:
            assert (r.rule, r.verdict) == (hit[0] + hit[1], hit[2])
        else:
            bare = re.sub(r"[.]+$", "", re.sub(r":[0-9]*$", "", host.split("@")[-1]))
            plain = re.sub(r"%([0-9A-Fa-f]{2})", lambda e: chr(int(e[1], 16)) if chr(int(e[1], 16)) in url_filters.UNRESERVED else e[0], path)
            if "/." in plain:
                plain = posixpath.normpath(plain).lstrip("/").join(["/", "/" if plain.endswith(("/", "/.", "/..")) else ""]).replace("//", "/")
            glob = next((g for g in url_filters.GLOB_RULES if fnmatch.fnmatchcase(bare, g.globs[0][0]) and fnmatch.fnmatchcase(plain, g.globs[0][1])), None)
            assert (r.rule, r.verdict, r.glob_rule) == (None, "block" if glob else "allow", glob and glob.name)


def test_urls_of_empty_repeated_and_clashing_tables(spark):
    rows = [(1, "http://a.org/x", "h"), (1, "http://a.org/x", "h"), (2, "http://b.net/l.png", "h")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string").selectExpr("*", "host AS verdict", "host AS glob_rule")
    got = sorted((r.page_id, r.host, r.verdict, r.glob_rule) for r in url_filters.filter_urls(df).collect())
    assert got == [(1, "a.org", "allow", None)] * 2 + [(2, "b.net", "block", "**.png")]
    assert url_filters.filter_urls(df.filter("false")).count() == 0


def test_thousands_of_globs_from_a_table(spark):
    rules = spark.range(3000).selectExpr("concat('*.host', id, '.net') AS host", "'/p*' AS path", "'block' AS verdict")
    df = spark.createDataFrame([(1, "http://a.host77.net/page"), (2, "http://a.host77.net/q"), (3, "http://host5.net/p")], "page_id long, url string")
    got = {r.page_id: r.glob_rule for r in url_filters.filter_urls(df, glob_rules=url_filters.rules_of(rules)).collect()}
    assert got == {1: "*.host77.net/p*", 2: None, 3: None}


# ---- top-k


def test_topk_against_brute_force(spark):
    r = np.random.default_rng(1)
    rows = [(i, [float(x) for x in r.normal(size=5)]) for i in range(150)] + [(200 + i, [0.5] * 5) for i in range(60)]
    rows += [(300, None), (320, []), (340, [1.0, None, 1.0, 1.0, 1.0]), (360, [float("nan")] * 5), (380, [float("inf")] * 5), (400, [1.0, 2.0]), (401, [2.0, 2.0]), (None, [1.0] * 5), (420, [1e6] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for x in topk_search.search(df, df.filter("vec_id % 20 = 0"), 7).collect():
        got[x.query_id].append((x.rank, x.vec_id, x.score))
    good = {i: [math.floor(64 * x) for x in v] for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    for q in good:
        if q % 20 == 0:
            s = sorted((-sum(a * b for a, b in zip(good[q], v)), i) for i, v in good.items() if i != q and len(v) == len(good[q]))[:7]
            assert sorted(got[q]) == [(k + 1, i, -x) for k, (x, i) in enumerate(s)]
    assert set(got) == {q for q in good if q % 20 == 0}
    none = spark.createDataFrame([], df.schema)
    assert topk_search.search(none, none).count() == 0


def test_topk_finds_every_score_that_a_long_holds(spark):
    rows = [(20, [1e7] * 4)] + [(i, [-1e7 - i] * 4) for i in range(1, 5)] + [(6, [3e7] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(x.rank, x.vec_id, x.score) for x in topk_search.search(df, df.filter("vec_id = 20"), 5).collect()]
    whole = {i: [math.floor(64 * x) for x in v] for i, v in rows}
    expect = sorted((-sum(a * b for a, b in zip(whole[20], v)), i) for i, v in whole.items() if i != 20)
    assert sorted(got) == [(k + 1, i, -s) for k, (s, i) in enumerate(expect)]
    edge = spark.createDataFrame([(0, [2.0**25, 0.0]), (1, [-(2.0**26), 0.0]), (2, [2.0**25, 0.0])], df.schema)  # 2^31 times -2^32 is the least long
    assert [(x.vec_id, x.score) for x in topk_search.search(edge, edge.filter("vec_id = 0"), 5).orderBy("rank").collect()] == [(2, 1 << 62), (1, -(1 << 63))]


def test_topk_ranks_what_no_long_holds_and_keeps_the_other_queries(spark):
    rows = [(0, [1e300, 0.0]), (1, [1.0, 2.0]), (2, [3e299, 1.0]), (3, [-1e300, 5.0]), (4, [2e299, 0.0]), (5, [4e299, 0.0]), (6, [-2e299, 0.0]), (7, [0.0, 0.0]), (8, [4e299, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {i: [math.floor(64 * x) for x in v] for i, v in rows}
    for k in (2, 3, 8):
        got = defaultdict(list)
        for x in topk_search.search(df, df, k).collect():
            got[x.query_id].append((x.rank, x.vec_id, x.score))
        for q in whole:
            exact = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:k]
            assert sorted(got[q]) == [(n + 1, i, max(-(1 << 63), min((1 << 63) - 1, -s))) for n, (s, i) in enumerate(exact)], q


def test_topk_counts_repeated_rows_and_ignores_other_columns(spark):
    rows = [(0, [1.0, 2.0]), (5, [1.0, 1.0]), (5, [1.0, 1.0]), (7, [1.0, 1.0])]
    df = spark.createDataFrame([(*r, "x", "x") for r in rows], "vec_id long, embedding array<double>, block string, score string")
    got = sorted((x.rank, x.vec_id, x.score) for x in topk_search.search(df, df.filter("vec_id = 0"), 3).collect())
    assert got == [(1, 5, 3 * 4096), (2, 5, 3 * 4096), (3, 7, 3 * 4096)]


def test_topk_sends_no_copies_of_the_queries_through_the_driver(spark):
    df = spark.createDataFrame([(i, [float(i % 7), float(i % 5)]) for i in range(40)], "vec_id long, embedding array<double>")
    packed = materialise(topk_search.blocks(topk_search.quantised(df, "vec_id", "embedding"), 8))
    pairs = topk_search._pairs(packed, packed, 5)  # of a few KB, by Spark's estimate as well, however many blocks there are
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert pairs.count() == packed.count() ** 2
    drop(packed)


# ---- mixing


def test_mixing_targets_and_limits(spark, frame, odd, empty):
    rows = [(i, prose(i % 50 + 1, i), None, "abcdefg"[min(i % 20, 6)], None) for i in range(4000)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS)).collect()
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken in (0, r.size, 2 * r.size)
    budget, weight = 1.5 * sum(size.values()), dict(zip("abcdefg", [3, 1, 2, 3, 1, 2, 3]))
    goal, open_, left = dict.fromkeys(size, 0.0), set(size), budget
    while left > 1e-6 and open_:  # deal by weight, fill up, deal what is over again
        share, left = left / sum(weight[s] for s in open_), 0.0
        for s in list(open_):
            goal[s] += share * weight[s]
            if goal[s] >= 2 * size[s]:
                left += goal[s] - 2 * size[s]
                goal[s] = 2 * size[s]
                open_.discard(s)
    for s in size:
        assert abs(target[s] - goal[s]) < 1e-3
        assert abs(taken[s] - goal[s]) <= 100
    out = mixing.mix(frame).collect()
    assert len(out) == len(odd)
    assert sorted(r.size for r in out) == sorted(len(WORD.findall(t or "")) for _, t, *_ in odd)
    assert mixing.mix(empty).count() == 0


def test_mixing_stage_repeats_rows(clashing, frame):
    plan = mixing.mix(clashing)
    out = mixing.take_mixed(clashing)
    assert out.columns == clashing.columns
    assert out.count() == sum(r.copies for r in plan.collect())


# ---- licenses


def test_licenses_against_plain_search(frame, spark, empty, clashing):
    texts = [None, "", "Under the MIT-License! under the mit license", "Apache License, Version 2.0", "CC BY-NC 4.0 cc by nc", "nothing here", "This work is licensed under the GNU General Public License, version 3.", "mit license", "é under THE mit LICENSEÉ"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    for r in license_scans.scan_licenses(df).collect():
        w = word.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in texts[r.doc_id] or ""))
        starts, labels = [], set()
        for p, label in license_scans.PHRASES.items():
            p = p.split()
            found = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            starts += found
            labels |= {label} if found else set()
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)))
        assert 0 <= r.score <= 1 and labels <= set(r.labels.split(","))
        if r.doc_id == 6:
            assert r.labels == "gpl-3"
        if r.doc_id in (0, 1, 5):
            assert r.labels == "" and r.score == 0
    assert license_scans.scan_licenses(empty).count() == 0
    assert license_scans.scan_licenses(clashing).count() == frame.count()


def licenses_by_force(words, idf):
    """Labels and score of all templates at all places, by plain dynamic programming."""
    labels, score = set(), 0.0
    drift, least = license_scans.DRIFT, license_scans.LEAST_SHARE
    for p, label in license_scans.PHRASES.items():
        p = p.encode().split()
        if any(words[k : k + len(p)] == p for k in range(len(words))):
            labels.add(label)
            score = 1.0
    for t in license_scans.TEMPLATES:
        notice, keys = t.notice.encode().split(), [k.encode().split() for k in t.keys]
        whole = sum(idf[w] for w in notice)
        for s in range(-len(notice), len(words)):
            at, ok = max(0, s - drift), True
            for k in keys:
                hit = next((i for i in range(at, min(len(words), s + len(notice) + drift) - len(k) + 1) if words[i : i + len(k)] == k), None)
                ok = ok and hit is not None
                at = (hit or 0) + len(k)
            if not ok:
                continue
            table = [[0.0] * (len(words) + 1) for _ in range(len(notice) + 1)]
            for a, w in enumerate(notice):
                for b, v in enumerate(words):
                    table[a + 1][b + 1] = max(table[a][b + 1], table[a + 1][b], table[a][b] + idf[w] if v == w and abs(b - a - s) <= drift else 0.0)
            share = table[-1][-1] / whole
            if share >= least:
                labels.add(t.label)
                score = max(score, share)
    return sorted(labels), round(min(score, 1.0), 6)


def test_notices_with_changes_against_brute_force():
    r = random.Random(12)
    df = {w: r.choice([0, 1, 3, 10, 60, 300]) for w in license_scans.vocabulary()}
    index = license_scans.RareTokenIndex(df, 400)
    short = [t for t in license_scans.TEMPLATES if len(t.notice.split()) < 45]
    found = 0
    for n in range(60):
        words = [w.encode() for w in prose(r.randint(0, 12), n).split()]
        for t in r.sample(short, r.randint(1, 2)):
            own = t.notice.encode().split()
            for _ in range(r.randint(0, 9)):
                k = r.randrange(len(own) + 1)
                own[k : k + r.randint(0, 1)] = [r.choice([b"the", b"license", b"odd", b"software"])] * r.randint(0, 2)
            words += own
        words = license_scans.fold(b" ".join(words))
        got = index.scan(words)
        assert (got[4], got[5]) == licenses_by_force(words, index.idf), b" ".join(words)
        found += bool(got[4])
    assert 20 < found < 60


def test_notices_with_an_inserted_word_ties_and_long_texts():
    index = license_scans.RareTokenIndex({}, 10)
    for label in ("mit", "gpl-2", "gpl-3", "lgpl-3", "bsd-2", "bsd-3", "apache-2", "cc-by-nc-sa"):
        t = next(t for t in license_scans.TEMPLATES if t.label == label)
        w = t.notice.encode().split()
        free = next(k for k in range(len(w) // 2, 0, -1) if not any(w[k - 1 : k + 1] == key.encode().split()[j : j + 2] for key in t.keys for j in range(9)))
        assert label in index.scan(w[:free] + [b"inserted"] + w[free:])[4]
        assert label in index.scan([b"filler"] * 20000 + w)[4]
    both = index.scan(next(t for t in license_scans.TEMPLATES if t.label == "bsd-3").notice.encode().split())  # two templates at one place
    assert {"bsd", "bsd-3"} <= set(both[4]) and both[5] == 1.0
    assert index.scan(b"redistribution and use in source and binary".split())[4] == []


# ---- SentencePiece


def test_pieces_are_the_models_own_and_decode(odd, frame, clashing):
    import sentencepiece

    c, model = sentencepiece_codec.PieceCodec(), sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    r, pieces = random.Random(6), [p.decode().replace("▁", " ") for p in sentencepiece_codec.PieceCodec().pieces]
    texts = ["a", " two  spaces ", "tab\tand\nline", "日本語 🎉", "nul\x00nul", "word" * 60, prose(40, 1), "y" * 5000, " " * 70 + "x" + " " * 3, ""]
    texts += ["".join(r.choice(pieces) for _ in range(r.randint(1, 30))) for _ in range(300)]
    for t, ids in zip(texts, c.encode_batch([t.encode() for t in texts])):
        assert list(ids) == model.encode(t), t[:20]
        assert c.decode(ids) == t.encode()
    assert c.decode(c.encode_batch(["▁ mark".encode()])[0]) == "▁ mark".encode()  # the library would give a space back
    back = sentencepiece_codec.decode(sentencepiece_codec.encode(frame)).collect()
    assert len(back) == len(odd) and all((r.text or "") == r.decoded for r in back)
    assert all(r.round_trip for r in sentencepiece_codec.encoding_digest(frame).collect())
    assert sentencepiece_codec.encode(clashing).columns[-1] == "_piece_ids"


def test_encoding_a_batch_holds_little_beside_its_texts():
    import tracemalloc

    c = sentencepiece_codec.PieceCodec()
    texts = [prose(2000, k % 20).encode() for k in range(400)]  # some 4 MB, few distinct chunks
    c.encode_batch(texts[:20])
    tracemalloc.start()
    found = c.encode_batch(texts)
    held, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(found) == 400 and most - held < 16 << 20  # chunks of all texts at once took more


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the generated tables are not here")
def test_pieces_of_the_generated_documents_are_the_models_own(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert all(list(r.piece_ids) == model.encode(r.text or "") for r in sentencepiece_codec.encode(docs).collect())


def test_codec_memo_is_bounded_in_bytes(monkeypatch):
    """Long chunks count by their length, and what is let go is encoded again."""
    monkeypatch.setattr(sentencepiece_codec, "MEMO_BYTES", 1 << 16)
    c, r = sentencepiece_codec.PieceCodec(), random.Random(8)
    texts = ["".join(r.choice("etaoin") for _ in range(8000)).encode() for _ in range(12)]
    first = [c.encode_batch([t])[0] for t in texts]
    assert sum(len(k) + len(v) for memo in (c.memo, c.older) for k, v in memo.items()) < 1 << 18
    assert c.encode_batch(texts) == first


def test_long_chunks_are_indexed_in_parts(monkeypatch):
    monkeypatch.setattr(sentencepiece_codec, "INDEX_BYTES", 128)
    c, d = sentencepiece_codec.PieceCodec(), "".join(random.Random(2).choice("etaoin") for _ in range(3000)).encode()
    one = c.encode_batch([d])[0]
    monkeypatch.setattr(sentencepiece_codec, "INDEX_BYTES", 1 << 18)
    assert sentencepiece_codec.PieceCodec().encode_batch([d])[0] == one


# ---- SimHash


def test_fingerprint_equals_definition():
    import xxhash

    for t in (None, "", "One", "one TWO", "a b c d e e e a b c", prose(200, 4), "É é A"):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = WORD.findall(low)
        sh = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        assert simhash_dedup.fingerprint(None if t is None else t.encode()) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint_of_a_text_of_several_pieces():
    """Words of ever other numbers, so that the pieces differ; one more and one less than full pieces."""
    import xxhash

    for n in (simhash_dedup.PIECE + 1, simhash_dedup.PIECE + 3, 2 * simhash_dedup.PIECE + 5):
        w = [f"w{k * k % (n // 3 + k // 1000)}" for k in range(n)]
        ones = np.zeros(64, int)
        for k in range(n - 2):
            h = xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42)
            ones += np.array([h >> b & 1 for b in range(64)])
        assert simhash_dedup.fingerprint(" ".join(w).upper().encode()) == sum(1 << b for b in range(64) if 2 * ones[b] > n - 2)


def test_masks_cover_every_pair_within_the_radius():
    from itertools import combinations

    masks = simhash_dedup.covering_masks()
    assert len(masks) == 15
    for bits in combinations(range(0, 64, 3), 3):
        d = sum(1 << b for b in bits)
        assert any(d & m == 0 for m in masks)


def test_links_and_components_against_brute_force(spark):
    r = random.Random(9)
    fps = {r.getrandbits(64) for _ in range(200)}
    for f in list(fps)[:60]:  # chains and dense groups
        for _ in range(12):
            for _ in range(r.randint(1, 3)):
                f ^= 1 << r.randrange(64)
            fps.add(f)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(i + 10, f) for i, f in enumerate(signed)], "doc_id long, fp long")
    got = {x.fp: x.component_id for x in simhash_dedup.class_components(df).collect()}
    label = list(range(len(fps)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    assert got == {f: find(i) + 10 for i, f in enumerate(signed)}


@pytest.mark.parametrize("large,few", [(40, 100_000), (3, -1)])
def test_overfull_buckets_lose_no_link(spark, monkeypatch, large, few):
    """A third of all fingerprints in one bucket: nested masks, then pairs of sub-blocks."""
    monkeypatch.setattr(simhash_dedup, "LARGE", large)
    monkeypatch.setattr(simhash_dedup, "BROADCAST_BUCKETS", few)
    r = random.Random(4)
    free = [i for i in range(64) if not simhash_dedup.covering_masks()[3] >> i & 1]
    fps = {r.getrandbits(64) for _ in range(100)}
    for _ in range(60):
        f = sum(1 << i for i in free if r.random() < 0.5)
        fps.add(f)
        for _ in range(2):
            for i in r.sample(free, r.randint(1, 3)):
                f ^= 1 << i
            fps.add(f)
    fps = sorted(fps)
    df = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)], "doc_id long, fp long")
    got = {x.fp % (1 << 64): x.component_id for x in simhash_dedup.class_components(df).collect()}
    label = list(range(len(fps)))
    for _ in fps:
        for i in range(len(fps)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= 3 and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
        if all(label[i] == label[j] for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3):
            break
    assert got == {f: label[i] for i, f in enumerate(fps)}


def test_nested_masks_cover_every_pair_of_a_bucket():
    from itertools import combinations

    nested = simhash_dedup.nested_masks()
    for t, m in enumerate(simhash_dedup.covering_masks()):
        free, own = [i for i in range(64) if not m >> i & 1], nested[15 * t : 15 * t + 15]
        assert all(x & m == 0 for x in own)
        assert all(any(sum(1 << b for b in bits) & x == 0 for x in own) for bits in combinations(free[::4], 3))


def test_near_duplicates_on_odd_rows(frame, odd, empty, clashing):
    got = simhash_dedup.near_duplicates(frame).collect()
    assert len(got) == len(odd)
    zero = [r for r in got if r.fingerprint == "0" * 16]
    assert len(zero) == 4 and {r.component_id for r in zero} == {0}
    assert {r.component_id for r in got if r.doc_id in (4, 5)} == {4}
    assert simhash_dedup.near_duplicates(empty).count() == 0
    out = simhash_dedup.keep_first(clashing)
    assert out.columns == clashing.columns
    ids = [r.doc_id for r in out.collect()]
    assert ids.count(4) == 1 and 5 not in ids and ids.count(7) == 2 and None not in ids


# ---- pipeline


def test_pipeline_runs_all_stages(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, prose(200, i) if i % 5 else prose(200, 0), "en", f"s{i % 3}", 1) for i in range(60)]
    rows += [(100 + i, "too short", "en", "s0", 1) for i in range(5)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in out}
    assert ids and ids <= {0, *(i for i in range(60) if i % 5)}
    assert all(len(r.piece_ids) for r in out)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name


def corpus():
    """Prose of two sources and none, and among it what each stage is to find. Returns rows and the ids that quality rejects."""
    r = random.Random(31)
    source = lambda i: "s0" if i % 3 == 0 else ("s1", None)[i % 2]
    texts = {i: prose(r.randint(80, 300), 2000 + i) for i in range(240)}
    for i in range(40):  # exact copies, and copies with other capitals, which link but do not cut
        texts[1000 + i] = texts[3 * i] if i % 2 else texts[3 * i].upper()
    for i in range(20):  # long texts in which a word has changed
        long = prose(2500, 3000 + i)
        texts[1100 + i], texts[1200 + i] = long, long.replace(" ", " altered ", 1)
    shared = [prose(60, 4000 + i) for i in range(3)]
    for i in range(30):  # passages that documents share, at the start or in the middle, and shorter ones that one has twice
        again = prose(25, 4300 + i) if i % 5 == 0 else ""
        texts[1300 + i] = "\n".join((prose(r.randint(0, 1) * 90, 4100 + i), shared[i % 3], again, prose(900 if again else 120, 4200 + i), again))
    good = len(texts)
    for i in range(6):
        texts[1400 + i] = prose(49, 5000 + i)
        texts[1410 + i] = " ".join(["one two three"] * 40) + prose(50, 5100 + i)
        texts[1420 + i] = " | ".join(prose(3, 5200 + 80 * i + k) for k in range(80))
    texts |= {1430: None, 1431: "", 1432: " \n"}
    rows = [(i, t, "en", source(i), None if t is None else len(t)) for i, t in texts.items()]
    return rows, {r[0] for r in rows[good:]}


def groups_by_force(fps):
    """The least id of each id's component, over all pairs of fingerprints."""
    label = {i: i for i in fps}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(fps)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_pipeline_rows_equal_the_stages_one_after_the_other(spark, tmp_path):
    """Every row of run(): planted rejects, all pairs of fingerprints, all 100-byte strings, the mix's SQL, the library's pieces."""
    import duckdb
    import pyarrow as pa
    import sentencepiece

    import corpus_pipeline

    rows, rejected = corpus()
    spark.createDataFrame(rows, DOCS).repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    docs = {r[0]: r for r in rows if r[0] not in rejected}
    for i, t, *_ in rows:
        n, _, _, _, repeat = base_statistics(t)
        assert i in rejected or (n >= 50 and 100 * (repeat or 0) <= 50 * n)
    first = groups_by_force({i: simhash_dedup.fingerprint(r[1].encode()) for i, r in docs.items()})
    singles = {i: r for i, r in docs.items() if first[i] == i}
    assert len(docs) - len(singles) >= 40
    cut = {}
    for i, b, gone in removed_by_force([(i, r[1]) for i, r in singles.items()]):
        if not gone or not all(gone):
            cut[i] = bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore")
    assert sum(cut[i] != singles[i][1] for i in cut) >= 25
    left = [(i, t, *singles[i][2:]) for i, t in cut.items()]
    con = duckdb.connect()
    con.register("documents", pa.table(dict(zip(("doc_id", "text", "lang", "source", "n_chars"), map(list, zip(*left))))))
    copies = {r[0]: r[-1] for r in con.execute(mixing.oracle_sql()).fetchall()}
    assert {0, 2} <= set(copies.values())
    model = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    expect = [(*r, tuple(model.encode(r[1]))) for r in left for _ in range(copies[r[0]])]
    got = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, tuple(r.piece_ids)) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(got, key=lambda r: r[0]) == sorted(expect, key=lambda r: r[0])


def test_pipeline_on_odd_and_empty_tables(spark, tmp_path, clashing):
    """Nulls in every column, repeated rows, long texts and clashing columns through all stages; then no rows."""
    import corpus_pipeline

    clashing.write.parquet(str(tmp_path / "odd" / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path / "odd"))
    assert out.columns[:-1] == clashing.columns and out.columns[-1] == "_piece_ids"
    rows = out.collect()
    codec = sentencepiece_codec.PieceCodec()
    assert rows and {r.doc_id for r in rows} <= {4, 5, 6, 7, 8, 11, None}
    import array as arrays

    assert all(codec.decode(arrays.array("i", r["_piece_ids"])) == r.text.encode() for r in rows)
    clashing.filter("false").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


# ---- many sources, many notices


def test_targets_of_many_sources(spark, monkeypatch):
    """Water filling source by source gives the same levels, however the sources fall into ranges."""
    monkeypatch.setattr(mixing, "RANGE_ROWS", 16)
    r = random.Random(8)
    sizes = {None: 500, "": 7, **{f"s{k:03}é": r.choice([0, 1, 10, 1000, 90_000]) for k in range(200)}}
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {x.source: x for x in mixing.targets(frame, (3, 1, 2), 1.5, 2).collect()}
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    budget, full = 1.5 * sum(sizes.values()), set()
    while True:
        left = budget - sum(2 * sizes[s] for s in full)
        share = left / (sum(weight[s] for s in names if s not in full) or 1)
        more = {s for s in names if s not in full and 2 * sizes[s] <= share * weight[s]}
        if not more:
            break
        full |= more
    assert set(got) == set(sizes) and 0 < len(full) < len(names)
    for s in names:
        assert math.isclose(got[s].target, 2 * sizes[s] if s in full else share * weight[s]), s
        assert got[s].budget == math.floor(budget + 0.5)


def test_share_of_a_notice_equals_all_chains():
    def brute(words, notice, weight, start):
        chains = []
        for p, (word, x) in enumerate(zip(notice, weight)):
            band = range(max(start + p - license_scans.DRIFT, 0), min(start + p + license_scans.DRIFT + 1, len(words)))
            chains += [(i, x + max((v for j, v in chains if j < i), default=0.0)) for i in band if words[i] == word]
        return max((v for _, v in chains), default=0.0) / sum(weight)

    r = random.Random(6)
    for _ in range(300):
        notice = [r.choice(b"abcde") for _ in range(r.randint(1, 25))]
        words = [r.choice(b"abcde") for _ in range(r.randint(0, 60))]
        weight = [r.random() + 0.1 for _ in notice]
        start = r.randint(-3, 60)
        assert math.isclose(license_scans.share_at(words, notice, weight, start), brute(words, notice, weight, start), abs_tol=1e-12)


def test_a_file_of_many_notices_takes_its_length():
    import time

    notice = next(t for t in license_scans.TEMPLATES if t.label == "mit").notice
    index = license_scans.RareTokenIndex({}, 10)
    took = []
    for n in (100, 1600):
        words = license_scans.fold((notice + " ").encode() * n)
        began = time.perf_counter()
        found = index.scan(words)
        took.append(time.perf_counter() - began)
        assert "mit" in found[4] and found[5] == 1.0
    assert took[1] < 60 * max(took[0], 0.01)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the generated tables are not here")
@pytest.mark.parametrize("name", ["op3_suffix_dedup", "op13_minhash_dedup"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    from tarnfield import llm

    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS FROM '/root/testdata/sf0.001/documents.parquet'")
    result = con.execute(llm.oracle_sql()[name])
    names = [d[0] for d in result.description]
    got = llm.queries()[name](spark, "/root/testdata/sf0.001").select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(result.fetchall())
