"""The prefix trie, the Merkle manifest and min-max hashing against brute force, and on odd inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tarnfield.llm import merkle_manifest, minhash_dedup, prefix_trie

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TURNS = "conv_id long, turn long, role string, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD_NAMES = ["n", "idx", "tree", "hash", "left", "right", "found", "digest", "sig", "bands", "md5", "place", "root", "part", "i", "j", "base", "heads", "key", "r", "run", "ends", "own_id", "seq", "range"]


def plain(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def clashing(frame):
    from pyspark.sql import functions as F

    return frame.withColumns({n: F.lit("x") for n in ODD_NAMES})


# ---- prefix trie


def turn_digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]


def brute_trie(rows, graft):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, turn_digest(role or "", text or ""), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if graft else 0
        whole[c] = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + v[h:]) if h else tuple(v)
    members = defaultdict(list)
    for c, p in whole.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, cs in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(cs) - 1) * (len(p[-1][1]) if p else 0)
    ends = {p: hashlib.sha256(",".join(map(str, sorted(c for c in cs if whole[c] == p))).encode()).hexdigest() for p, cs in members.items()}
    return plain((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), children[p], leaves[p], saved[p], ends[p]) for p, cs in members.items())


def odd_turns():
    r = random.Random(5)
    rows = [(7, None, None, None), (7, 0, "user", ""), (7, 0, "user", ""), (7, 1, None, "é" * 9), (8, 3, "u", "x" * 50_000), (None, 0, "u", "nobody"), (None, None, None, None), (300, 0, "u", "a")]
    rows += [(c, t, r.choice(["u", "a"]), r.choice(["a", "b", "é"])) for c in range(-130, 330) for t in range(r.randint(1, 9))]  # repeated ids, ties in the turns of 7, 8 and 300
    rows += [(c, t, "u", "copy") for c in range(1000, 1120) for t in range(3)]  # copies of one conversation
    rows += [(2000, t, "u", f"deep {t}") for t in range(700)] + [(2001, t, "u", f"deep {t}") for t in range(650)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("graft", [True, False])
@pytest.mark.parametrize("small", [True, False])
def test_prefix_trie(spark, graft, small, monkeypatch):
    if small:  # a dozen ranges, so that hot nodes, their lists of ids and copies go over many of them
        monkeypatch.setattr(prefix_trie, "RANGE_TURNS", 150)
        monkeypatch.setattr(prefix_trie, "BROADCAST_BORDER", 0)
        monkeypatch.setattr(prefix_trie, "RUN_TURNS", 500)
    rows = odd_turns()
    frame = clashing(spark.createDataFrame(rows, TURNS).repartition(5))
    if graft:
        from pyspark.sql import functions as F

        own = F.col("conv_id")
        got = prefix_trie.prefix_trie(prefix_trie.paths(frame.select("conv_id", "turn", "role", "text"), own - own % 100, F.crc32(own.cast("string").cast("binary")) % 6, 5))
    else:
        got = prefix_trie.conversation_trie(frame)
    assert plain(got.collect()) == brute_trie(rows, graft)


def test_prefix_trie_of_nothing(spark):
    assert prefix_trie.conversation_trie(spark.createDataFrame([], TURNS)).collect() == []
    assert prefix_trie.conversation_trie(spark.createDataFrame([(None, 1, "u", "x")], TURNS)).collect() == []


def test_runs_and_splitters():
    r = random.Random(2)
    keys = sorted({prefix_trie.sort_key(b"".join(bytes([r.randrange(3)]) * 16 for _ in range(r.randrange(6))), r.randrange(-50, 50)) for _ in range(300)})
    rows = [(k, np.arange(len(k) // prefix_trie.STEP, dtype=np.int64)) for k in keys]
    back = list(prefix_trie.decode_run(prefix_trie.encode_run(rows)))
    assert [b[1] for b in back] == keys and all((b[2] == x[1]).all() for b, x in zip(back, rows))
    cuts = prefix_trie.splitters([(k, 1) for k in keys], 12)
    assert cuts == sorted(cuts) and 8 <= len(cuts) <= 11
    assert max(map(len, cuts)) <= max(map(len, keys))
    tree = prefix_trie.LoserTree([prefix_trie.decode_run(prefix_trie.encode_run(rows[k::4])) for k in range(4)])
    assert [x[1] for x in tree] == keys
    assert tree.compared < 0.6 * sum(map(len, keys))  # shared turns are not looked at again


# ---- Merkle manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def doc_leaf(row, text):
    doc, _, lang, source, n_chars = row
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, n_chars, text)))


def level_lists(hashes):
    out = [hashes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][k : k + 3]) for k in range(0, len(out[-1]), 3)])
    return out


def brute_manifest(rows):
    by = defaultdict(list)
    for row in rows:
        by[row[3]].append(row)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        by[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, doc_leaf(x, x[1])))
    trees = {s: level_lists([doc_leaf(x, x[1]) for x in by[s]]) for s in sources}
    top = level_lists([trees[s][-1][0] for s in sources])
    out = []
    for at, s in enumerate(sources):
        for k, row in enumerate(by[s]):
            steps = []
            for levels, i in ((trees[s], k), (top, at)):
                for hashes in levels[:-1]:
                    run = i - i % 3
                    steps.append((hashes[run:i], hashes[i + 1 : run + 3]))
                    i //= 3
            text = row[1]
            if text is not None and zlib.crc32(str(row[0] if row[0] is not None else "").encode()) % 2 == 0:
                text = text.replace("\n", "")
            folded = doc_leaf(row, text)
            for a, b in steps:
                folded = sha(*a, folded, *b)
            root = top[-1][0]
            out.append((row[0], doc_leaf(row, row[1]), trees[s][-1][0], root, sha(*(x for a, b in steps for x in a + b)), folded, folded == root))
    return plain(out)


def manifest_of(frame, **more):
    from pyspark.sql import functions as F

    half = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 2 == 0
    return merkle_manifest.manifest(frame, altered={"text": F.when(half, F.translate("text", "\n", "")).otherwise(F.col("text"))}, **more)


def odd_docs():
    big = (1 << 62) + 1  # a double would not hold it
    rows = [(k, f"line {k}\nline" * (k % 3), ["en", None][k % 2], ["hot", "hot", "é", None, "b"][k % 5], k) for k in range(100)]
    rows += [(None, "x\n", None, "hot", None), (None, None, None, None, None), (big, "y\ny", "en", "hot", 1), (big, "y\ny", "en", "hot", 1), (big + 1, "", "en", "", 0), (5, "long\n" * 50_000, "de", "only one", 3)]
    return rows


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_merkle_manifest(spark, levels):
    rows = odd_docs()
    frame = clashing(spark.createDataFrame(rows, DOCS).repartition(3))
    got = plain(manifest_of(frame, levels=levels).collect())
    assert got == brute_manifest(rows)
    assert 0 < sum(not r[-1] for r in got) < len(got)


def test_merkle_manifest_of_little(spark):
    assert manifest_of(spark.createDataFrame([], DOCS)).collect() == []
    one = [(1, "a\nb", "en", "s", 3)]
    assert plain(manifest_of(spark.createDataFrame(one, DOCS)).collect()) == brute_manifest(one)
    copies = [(1, "same", "en", "s", 4)] * 40
    assert plain(manifest_of(spark.createDataFrame(copies, DOCS), levels=2).collect()) == brute_manifest(copies)


# ---- min-max hashing


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_minhash(rows, width=3, percent=85):
    sets = []
    for _, text in rows:
        w = words_of(text)
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    label = list(range(len(rows)))

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                label[top(i)] = top(j)
    least = {}
    for k, (doc, _) in enumerate(rows):
        if doc is not None:
            least[top(k)] = min(least.get(top(k), doc), doc)
    return plain((doc, len(sets[k]), least.get(top(k)) if sets[k] else doc, doc == (least.get(top(k)) if sets[k] else doc)) for k, (doc, _) in enumerate(rows))


def near_texts(seed=4):
    r = random.Random(seed)
    vocab = [f"w{k}é" for k in range(400)]
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "one two three"), (8, "one two two one"), (None, "one"), (None, "nobody else has this"), (9, "x " * 3000), (9, "z " + "x " * 3000)]
    for family in range(12):
        base = [r.choice(vocab) for _ in range(r.choice([12, 40, 200, 900]))]
        for copy in range(14):  # from copies to texts on either side of the threshold
            own = list(base)
            for _ in range(int(len(own) * r.choice([0, 0, 0.01, 0.03, 0.05, 0.08]))):
                own[r.randrange(len(own))] = r.choice(vocab)
            rows.append((1000 + 20 * family + copy, " ".join(own)))
    rows.append((5000, " ".join(r.choice(vocab) for _ in range(60_000))))
    rows.append((5001, rows[-1][1] + " tail"))
    rows += [rows[20], rows[20], (77, rows[20][1])]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("small", [True, False])
def test_minhash_dedup(spark, small, monkeypatch):
    if small:  # bands and clusters beyond a group are dealt into blocks, texts are read in pieces
        monkeypatch.setattr(minhash_dedup.clusters, "__defaults__", (4,))
        monkeypatch.setattr(minhash_dedup.confirmed, "__defaults__", (500,))
        monkeypatch.setattr(minhash_dedup, "PIECE", 100)
        monkeypatch.setattr(minhash_dedup, "CHUNK", 1000)
    rows = near_texts()
    frame = clashing(spark.createDataFrame([(d, t, None, None, None) for d, t in rows], DOCS).repartition(4))
    got = plain(minhash_dedup.near_duplicates(frame).collect())
    assert got == brute_minhash(rows)
    assert 20 < sum(not r[3] for r in got) < 150


def test_minhash_of_nothing_and_other_settings(spark):
    assert minhash_dedup.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []
    blank = spark.createDataFrame([(1, None, None, None, None), (2, " ", None, None, None)], DOCS)
    assert plain(minhash_dedup.near_duplicates(blank).collect()) == [(1, 0, 1, True), (2, 0, 2, True)]
    rows = [x for x in near_texts(6) if x[0] is None or x[0] < 1200]
    frame = spark.createDataFrame([(d, t, None, None, None) for d, t in rows], DOCS)
    assert plain(minhash_dedup.near_duplicates(frame, width=5, percent=80).collect()) == brute_minhash(rows, 5, 80)


def test_min_max_values_are_unbiased():
    family = minhash_dedup.MinMax(85)
    assert 2 * family.permutations == family.rows * family.bands
    r = np.random.default_rng(1)
    for share in (0.5, 0.8):
        agree = []
        for _ in range(150):
            x = r.integers(0, 1 << 63, 300, dtype=np.uint64)
            n = round(300 * (1 - share) / 2)
            v = family.values([np.sort(x[n:]), np.sort(x[: 300 - n])])
            agree.append((v[0] == v[1]).mean())
        true = (300 - 2 * n) / 300
        assert abs(np.mean(agree) - true) < 0.02
        assert np.var(agree) < 1.15 * true * (1 - true) / (2 * family.permutations)
