"""License scans, lexical search and the prefix trie against brute force on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from costlens.llm import common, lexical, licenses, prefix_trie
from costlens.llm.decontaminate import words_of

DOCS = "doc_id long, text string, n_words long, places string, rank int, item string, score int"


def table(spark, texts, parts=3):
    rows = [(i, t, 1, "x", 2, "y", 3) for i, t in texts]
    return spark.createDataFrame(rows, DOCS).repartition(parts)


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
plain = lambda t: WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


# --- license scans


def license_texts():
    gpl = licenses.TEMPLATES[0][0]
    isc = licenses.TEMPLATES[6][0].split()
    filler = ["und", "ça", "the", "of", "license", "public", "Version", "x9", "software", "licensed"]
    rng = random.Random(4)
    long = [rng.choice(filler) for _ in range(50_000)]
    texts = [None, "", " \n\t", "GNU General\nPublic-License", "Released under the MIT License.", "MIT LICENSE mit license", "mit\x01license cc, by", "the mit licenses", "gnu general public public license"]
    texts += [gpl, gpl.replace("redistribute", "share"), " ".join(gpl.split()[:20]), "\n".join(isc), " ".join(isc[::-1]), " ".join(isc[k] for k in range(len(isc)) if k % 4)]
    texts += [" ".join([*long[: 17 * k], *isc, *long[:k], "Licensed under CC BY-NC 4.0.", *long[:40]]) for k in range(6)]
    texts += [" ".join([*long, gpl, "apache license"]), "Licensed under CC BY-NC 4.0.", "Licensed under CC BY-NC 4.0."]
    return [(k, t) for k, t in enumerate(texts)] + [(None, "apache license"), (3, "apache license"), (3, "apache license")]


def scan_plainly(texts, templates=licenses.TEMPLATES, phrases=licenses.PHRASES, threshold=0.8):
    out = []
    for i, t in texts:
        w = plain(t)
        places = sorted((label, p) for phrase, label in phrases for p in range(len(w)) if plain(phrase) and w[p : p + len(plain(phrase))] == plain(phrase))
        blocks = []
        for k, (text, label) in enumerate(templates):
            own = plain(text)
            for lo in range(0, len(w), len(own) or 1):
                n = len(set(own) & set(w[lo : lo + 2 * len(own)]))
                if own and n >= threshold * len(set(own)) - 1e-9:
                    blocks.append((k, label, lo, n / len(set(own))))
        out.append((i, len(w), places, sorted(blocks)))
    return sorted(out, key=str)


def test_license_scan(spark):
    texts = license_texts()
    got = licenses.scan_licenses(table(spark, texts)).collect()
    assert sorted(((r["doc_id"], r["n_words"], sorted(map(tuple, r["places"])), sorted(map(tuple, r["blocks"]))) for r in got), key=str) == scan_plainly(texts)
    assert licenses.scan_licenses(table(spark, texts).limit(0)).count() == 0


def test_license_scan_of_other_templates(spark):
    texts = license_texts()[:12]
    templates, phrases = [("", "none"), ("...", "none"), ("license", "one"), ("the the license", "two")], [("", "no"), ("the", "t"), ("public public", "p")]
    got = licenses.scan_licenses(table(spark, texts), templates, phrases, 0.5).collect()
    names = lambda rows: [(i, n, p, [x[1:] for x in b]) for i, n, p, b in rows]
    assert names(sorted(((r["doc_id"], r["n_words"], sorted(map(tuple, r["places"])), sorted(map(tuple, r["blocks"]))) for r in got), key=str)) == names(scan_plainly(texts, templates, phrases, 0.5))
    with pytest.raises(ValueError, match="words together"):
        licenses.scan_licenses(table(spark, texts), [("a " * (licenses.MAX_WORDS + 1), "long")])


def test_filters_lose_no_block():
    """Prefix, length and position against counting every block, over random words of uneven frequency."""
    rng = random.Random(8)
    for trial in range(40):
        vocabulary = [f"w{k}" for k in range(rng.choice([6, 12, 40]))]
        pick = lambda n: [vocabulary[min(int(rng.expovariate(4 / len(vocabulary))), len(vocabulary) - 1)] for _ in range(n)]  # noqa: B023, E731
        templates = [" ".join(pick(rng.randrange(1, 12))) for _ in range(3)]
        texts = [" ".join(pick(rng.randrange(0, 80))) for _ in range(12)]
        share = rng.choice([0.3, 0.6, 0.8, 1.0])
        often = {int(licenses.hash_words([w.encode()])[0]): rng.randrange(9) for w in vocabulary}
        own = licenses.TemplateSet([(words_of(t.encode()), str(k), share, False) for k, t in enumerate(templates)], often)
        assert [often[int(licenses.hash_words([w])[0])] for w in own.tokens] == sorted(often[int(licenses.hash_words([w])[0])] for w in own.tokens)
        _, _, blocks = licenses._scan_slice([t.encode() for t in texts], own)
        want = [b for _, _, _, b in (scan_plainly([(k, t)], [(x, str(j)) for j, x in enumerate(templates)], [], share)[0] for k, t in enumerate(texts))]
        assert [sorted((b["template"], b["label"], b["word"], b["share"]) for b in row) for row in blocks] == want, trial


# --- lexical search


def search_plainly(texts, items, k=10):
    docs = [(i, plain(t)) for i, t in texts if plain(t)]
    n_docs, n_terms = len(docs), sum(len(w) for _, w in docs)
    df = collections.Counter(t for _, w in docs for t in set(w))
    out = []
    for item in dict.fromkeys(i for i, _ in items):
        terms = {t for i, x in items if i == item for t in plain(x)}
        scored = []
        for i, w in docs:
            tf, m = collections.Counter(w), 10 + 90 * len(w) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m)) for t in terms if tf[t])
            if s > 0:
                scored.append((-s, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


def search_texts():
    rng = random.Random(2)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % 400}"
    texts = [" ".join(word() for _ in range(rng.randrange(1, 60))) for _ in range(300)]
    texts += [None, "", " ,.\n", "Ünï ça W3", texts[5], " ".join(word() for _ in range(40_000))] + [texts[7]] * 60
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return [*zip(ids, texts, strict=True), (ids[9], texts[9]), (None, texts[7]), (None, texts[11])]


ITEMS = [(1, "w1 w2 W3 w17 w201"), (2, ""), (3, None), (4, "nowhere"), (5, "ünï Ünï w9 w9"), (None, "w4 w5 w6 w7 w8"), (7, "w1"), (7, "w33 w2"), (8, "w250 w251 w252 w30"), (8, "w250 w251 w252 w30")]


@pytest.mark.parametrize("block", [200, 20_000, 1 << 23])
def test_search(spark, block):
    texts = search_texts()
    items = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id int, text string, term string")
    index = lexical.build_index(table(spark, texts), block=block).persist()
    for k in (10, 3):
        got = lexical.search(index, items, k=k).collect()
        assert sorted(map(tuple, got), key=str) == search_plainly(texts, ITEMS, k)
    if block == 200:
        assert index.count() > 100
    none = lexical.build_index(table(spark, texts).limit(0))
    assert lexical.search(none, items).count() == 0 and lexical.search(index, items.limit(0)).count() == 0
    index.unpersist()


def test_search_with_queries_in_blocks(spark, monkeypatch):
    texts = search_texts()
    items = spark.createDataFrame(ITEMS, "item_id int, text string")
    monkeypatch.setattr(lexical, "MAX_PAIRS", 4)
    monkeypatch.setattr(lexical, "PARTS", 2)
    assert sorted(map(tuple, lexical.search(lexical.build_index(table(spark, texts)), items).collect()), key=str) == search_plainly(texts, ITEMS)


def test_treaps_are_in_search_and_heap_order():
    rng = np.random.default_rng(3)
    for size in ([1], [5, 1, 300], [2000]):
        starts = np.concatenate(([0], np.cumsum(size)))
        impact = rng.integers(0, 6, starts[-1])  # many ties
        left, right, roots = lexical.treaps(starts, impact)
        for i, root in enumerate(roots.tolist()):
            seen, todo, deepest = [], [(root, starts[i], starts[i + 1], 1)], 0
            while todo:
                node, lo, hi, depth = todo.pop()
                assert lo <= node < hi and impact[node] == impact[lo:hi].max()
                seen.append(node)
                deepest = max(deepest, depth)
                todo += [(int(x), a, z, depth + 1) for x, a, z in ((left[node], lo, node), (right[node], node + 1, hi)) if x >= 0]
            assert sorted(seen) == list(range(starts[i], starts[i + 1])) and deepest < 60  # copies make no chains


def walk_once(texts, items, monkeypatch, walk=None):
    if walk:
        monkeypatch.setattr(lexical, "WALK", walk)
    row = lexical._block(pa.array([i for i, _ in texts]), [(t or "").encode() for _, t in texts])
    cells = [x if isinstance(x, pa.Array) else pa.array(x) for x in row[2:]]
    pairs = sorted({(i, int(h)) for i, t in items for h in lexical._terms_of([t.encode()])[0]})
    found = dict(zip(row[4].tolist(), np.diff(row[5]).tolist(), strict=True))
    wanted = lexical.Queries(pairs, found, row[0], row[1])
    best = lexical.Best(len(wanted.items), wanted.k)
    lexical.search_block(cells, wanted, best)
    return best


def test_subtrees_are_pruned_and_queries_walked_in_groups(monkeypatch):
    rng = random.Random(6)
    texts = [(k, " ".join(f"w{int(rng.paretovariate(0.5)) % 3000}" for _ in range(rng.randrange(20, 200)))) for k in range(3000)]
    items = [(k, f"w{k} w{k + 1} w{40 + k} w{90 + k}") for k in range(12)]
    best = walk_once(texts, items, monkeypatch)
    assert best.scored < 0.35 * sum(any(f"w{x}" in t.split() for x in (k, k + 1, 40 + k, 90 + k)) for k in range(12) for _, t in texts)
    groups = walk_once(texts, items, monkeypatch, 10_000)
    assert (groups.score == best.score).all() and (groups.doc == best.doc).all()
    got = sorted((i, r + 1, int(best.doc[i, r]), int(best.score[i, r])) for i in range(12) for r in range(10) if best.score[i, r])
    assert sorted(got, key=str) == search_plainly(texts, items)


def test_rows_and_files_of_the_index_are_small(spark, tmp_path, monkeypatch):
    rng = random.Random(8)
    docs = [(k, " ".join(f"w{rng.randrange(5000)}" for _ in range(2000))) for k in range(800)]
    pq.write_table(pa.table({"doc_id": [k for k, _ in docs], "text": [t for _, t in docs]}), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"item_id": [1, 2], "text": ["w1 w2 w3", "w4 w4 w5"]}), tmp_path / "benchmark.parquet")
    seen, search = [], lexical.search
    monkeypatch.setattr(lexical, "search", lambda index, *a, **k: seen.append(index) or search(index, *a, **k))
    got = lexical.op12_lexical_search(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == search_plainly(docs, [(1, "w1 w2 w3"), (2, "w4 w5")])
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in seen[0].inputFiles()]
    assert sum(m.num_rows for m in files) >= 18  # nine megabytes of text
    assert max(m.row_group(g).total_byte_size for m in files for g in range(m.num_row_groups)) < 10 << 20
    assert seen[0].agg(F.max(16 * F.size("terms") + 8 * F.size("places"))).first()[0] < 1 << 20


def test_blocks_are_searched_together(monkeypatch):
    texts = search_texts()
    texts = [(i, t) for i, t in texts if i is not None] + [(None, texts[7][1])]
    items = [(k, x) for k, (_, x) in enumerate(ITEMS) if x]
    whole = walk_once(texts, items, monkeypatch)
    row = lexical._block(pa.array([i for i, _ in texts]), [(t or "").encode() for _, t in texts])
    pairs = sorted({(i, int(h)) for i, t in items for h in lexical._terms_of([t.encode()])[0]})
    wanted = lexical.Queries(pairs, dict(zip(row[4].tolist(), np.diff(row[5]).tolist(), strict=True)), row[0], row[1])
    blocks = [lexical._block(pa.array([i for i, _ in texts[lo : lo + 7]], pa.int64()), [(t or "").encode() for _, t in texts[lo : lo + 7]]) for lo in range(0, len(texts), 7)]
    parts = [lexical.postings([x if isinstance(x, pa.Array) else pa.array(x) for x in b[2:]], wanted) for b in blocks if b]
    for size in (1, 5, len(parts)):
        best = lexical.Best(len(wanted.items), wanted.k)
        for lo in range(0, len(parts), size):
            lexical.search_postings(parts[lo : lo + size], wanted, best)
        assert (best.score == whole.score).all() and (best.doc == whole.doc).all()


def test_an_index_built_from_small_batches(spark, monkeypatch):
    texts, items = search_texts(), spark.createDataFrame(ITEMS, "item_id int, text string")
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    monkeypatch.setattr(lexical, "BATCH", 4000)
    index = lexical.write_index(lexical.build_index(table(spark, texts)))
    assert index.count() > 6 and spark.conf.get(key) == before  # three partitions
    assert sorted(map(tuple, lexical.search(index, items).collect()), key=str) == search_plainly(texts, ITEMS)


def test_a_setting_ends_with_its_block(spark):
    for key, before in (("spark.sql.shuffle.partitions", "4"), ("spark.costlens.none", None)):
        with pytest.raises(ZeroDivisionError), common.setting(spark, key, 4000):
            assert spark.conf.get(key) == "4000"
            1 / 0
        assert spark.conf.get(key, None) == before


def test_slices_of_a_column():
    texts = ["", None, "ab", "é" * 9, None, "x" * 50, "c", "d"]
    for kind in (pa.string(), pa.large_string()):
        for column in (pa.array(texts, kind), pa.array(["z" * 30, *texts], kind).slice(1)):
            for limit in (1, 20, 1000):
                got = list(common.column_slices(column, limit))
                assert [(lo, hi) for lo, hi, _ in got] == list(common.slices([(t or "").encode() for t in texts], limit))
                assert [x for _, _, part in got for x in part] == [(t or "").encode() for t in texts]
    assert not list(common.column_slices(pa.array([], pa.string())))


# --- prefix trie


def trie_plainly(conversations, every=5, most=9):
    sha = lambda r, t: hashlib.sha256(f"{len((r or '').encode())}:{r or ''}{t or ''}".encode()).digest()
    own = collections.defaultdict(list)
    for c, turn, r, t in conversations:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), sha(r, t), len((t or "").encode())))
    own = {c: [x[1:] for x in sorted(rows)] for c, rows in own.items()}
    members, ends, size = collections.defaultdict(list), collections.defaultdict(list), {}
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % most
        base = c - int(math.fmod(c, every))
        turns = own.get(base, [])[:h] + own[c][h:]
        for d in range(len(turns) + 1):
            key = tuple(x[0] for x in turns[:d])
            members[key].append(c)
            size[key] = turns[d - 1][1] if d else 0
        ends[tuple(x[0] for x in turns)].append(c)
    out = []
    for key, own_members in members.items():
        below = [k for k in members if k[: len(key)] == key]
        kids = [k for k in below if len(k) == len(key) + 1]
        leaves = [k for k in below if not any(x[: len(k)] == k and len(x) == len(k) + 1 for x in below)]
        saved = sum((len(members[k]) - 1) * size[k] for k in below)
        joined = ",".join(map(str, ends.get(key, [])))
        out.append((min(own_members), len(key), min(members[key[:-1]]) if key else None, len(own_members), len(kids), len(leaves), saved, hashlib.sha256(joined.encode()).hexdigest()))
    return sorted(out, key=str)


def talks():
    rng = random.Random(1)
    rows = []
    for c in [*range(-7, 12), 15, 21, 22, 23, 1000, 1003]:
        rows += [(c, k, rng.choice(["user", "assistant"]), f"turn {rng.randrange(3)} é") for k in range(rng.randrange(1, 7))]
    rows += [(25, 0, "user", "only"), (26, 0, "user", "one")]  # may come out without turns
    rows += [(30, None, None, None), (30, 2, "", "x"), (30, 2, "", "x"), (30, 2, "a", "y"), (30, None, "b", None), (None, 0, "user", "nobody")]
    rows += [(100 + 5 * k, t, "user", "hello" if t < 2 else f"copy {t}") for k in range(40) for t in range(12)]  # copies
    rows += [(400 + 5 * k, t, "user", "hello" if t < 1 else f"own {k}") for k in range(40) for t in range(3)]  # one first turn
    rows += [(700 + 5 * k, t, "user", "x" * (3 + t // (100 * (k + 1)))) for k in range(2) for t in range(300)]  # long
    return rows


def test_trie(spark):
    rows = [(*r, "clash", 5) for r in talks()]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, node string, depth int").repartition(5)

    def trie(df):
        turns = prefix_trie.turn_digests(df)
        members = turns.where("nth = 0").select("conv_id")
        return prefix_trie.trie(prefix_trie.prefixes(prefix_trie.share_openings(turns, members), members))

    got = sorted(map(tuple, trie(df).collect()), key=str)
    assert got == trie_plainly(talks())
    assert any(r[1] == 0 and r[7] != prefix_trie.EMPTY for r in got)  # some conversation has no turns
    assert trie(df.limit(0)).count() == 0


def test_hot_parents_are_met_by_broadcast(spark, monkeypatch):
    from costlens.llm import common

    monkeypatch.setattr(common, "HOT", 3)
    turns = prefix_trie.turn_digests(spark.createDataFrame(talks(), "conv_id long, turn long, role string, text string"))
    members = turns.where("nth = 0").select("conv_id")
    got = prefix_trie.trie(prefix_trie.prefixes(prefix_trie.share_openings(turns, members), members)).collect()
    assert sorted(map(tuple, got), key=str) == trie_plainly(talks())


def test_ids_of_one_node_are_packed_and_digested_as_a_stream(monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 100)
    rng = random.Random(5)
    ends = sorted((bytes([rng.choice([1, 1, 1, 2, 3])]) * 32, k) for k in rng.sample(range(-500, 5000), 700))
    batches = lambda rows, names, step: [pa.RecordBatch.from_pydict({n: [r[i] for r in rows[k : k + step]] for i, n in enumerate(names)}) for k in range(0, len(rows), step)]
    packed = [r for part in (ends[:300], ends[300:]) for b in prefix_trie._pack_ids(iter(batches(part, ["node", "conv_id"], 64))) for r in zip(*b.to_pydict().values(), strict=True)]
    assert 100 < len(packed) < 300 and max(len(r[2]) for r in packed) < 150
    got = {k: v for b in prefix_trie._hash_ids(iter(batches(sorted(packed), ["node", "least", "ids"], 7))) for k, v in zip(*b.to_pydict().values(), strict=True)}
    assert got == {n: hashlib.sha256(",".join(str(k) for m, k in ends if m == n).encode()).hexdigest() for n, _ in ends}
