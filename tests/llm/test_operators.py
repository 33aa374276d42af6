"""Every operator against a brute-force version on a small fixture with nulls, ties and odd texts."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from strandlake.llm.shared import materialise as shared_materialise
from strandlake.llm import components, decontaminate, exact_dedup, line_dedup, mixing, quality, sharding, simhash, substring_dedup, token_records, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def first(x):
    """Null ids sort before all others."""
    return (x is not None, x if x is not None else 0)


def test_sharding(docs, empty):
    got = sharding.shard_documents(docs, n_shards=7).collect()
    assert len(got) == docs.count() and Counter(r.score for r in got) == Counter(r.score for r in docs.collect())
    assert set(got[0].asDict()) == {*docs.columns, "shard", "slot"}
    sizes, slots = Counter(), defaultdict(list)
    for r in got:
        sizes[r.shard] += len((r.text or "").encode()) + 8
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(len((r.text or "").encode()) for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 2 * (largest + 8)
    assert sharding.shard_documents(empty).count() == 0


def test_sharding_cuts_a_hot_text(spark):
    rows = [(k, "same text" if k % 3 else f"text {k}") for k in range(600)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), n_shards=6, hot_parts=16).collect()
    sizes = Counter()
    for r in got:
        sizes[r.shard] += len(r.text) + 8
    assert max(sizes.values()) <= 1.03 * min(sizes.values())
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got))) for s in range(6))


@pytest.mark.parametrize("far", [[1 << 60], [None] * 300, [-(1 << 62)] * 3])
def test_sharding_cuts_hot_cells_by_counts(spark, far):
    """Outlying and null ids leave no range of ids with most of a hot text's rows."""
    rows = [(k, "same text") for k in range(900)] + [(f, "same text") for f in far]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    keys = table.select(F.lit(5).alias("__cell"), F.coalesce("doc_id", F.lit(-1)).alias("__d"))
    subs = Counter(r["__sub"] for r in sharding._cut(keys, sharding._hot_cuts(keys, {5: 16})).collect())
    assert len(subs) >= 10 and max(subs.values()) <= max(150, 2 * len(far))
    got = sharding.shard_documents(table, n_shards=6, hot_parts=16).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert len(got) == len(rows) and all(sorted(s) == list(range(len(s))) for s in slots.values())


@pytest.mark.parametrize("repeated", [(7, "a text that comes many times"), (None, "a text that comes many times")])
def test_sharding_parts_rows_that_repeat(spark, repeated):
    """A third of the rows are equal in id and text, or have no id: the law of bytes holds for them too."""
    rows = [(k, f"text {k} " + "x" * (k % 37)) for k in range(2000)] + [repeated] * 1000
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = sharding.shard_documents(table).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(rows)
    sizes, slots = Counter(), defaultdict(list)
    for r in got:
        sizes[r.shard] += len(r.text) + 8
        slots[r.shard].append(r.slot)
    assert sorted(sizes) == list(range(24)) and max(sizes.values()) - min(sizes.values()) <= 2 * 60
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    keys = table.select(F.lit(0).cast("long").alias("__cell"), F.monotonically_increasing_id().alias("__d"))
    parts = Counter(r["__sub"] for r in sharding._cut(keys, sharding._hot_cuts(keys, {0: 60})).collect())
    assert max(parts.values()) <= len(rows) / 20


def test_sharding_without_any_ids(spark):
    rows = [(None, "t" * (k % 50 + 1)) for k in range(3000)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), n_shards=5).collect()
    sizes = Counter()
    for r in got:
        sizes[r.shard] += len(r.text) + 8
    assert len(got) == 3000 and max(sizes.values()) - min(sizes.values()) <= 2 * 58


@pytest.mark.parametrize("most_bits", [4, 27])
@pytest.mark.parametrize("digest", [exact_dedup.sha256_digest, lambda t: (F.crc32(F.coalesce(t, F.lit("")).cast("binary")) % 5).cast("string")])
@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_duplicates(docs, empty, digest, keep, most_bits):
    """A weak digest puts different texts together: the bytes tell them apart."""
    got = exact_dedup.exact_duplicates(docs, keep, digest, most_bits).collect()
    groups = defaultdict(list)
    for r in docs.collect():
        groups[r.text or ""].append(r.doc_id)
    best = max if keep == "largest" else min
    want = sorted((first(i), first(best(ids, key=first)), len(ids)) for ids in groups.values() for i in ids)
    assert sorted((first(r.doc_id), first(r.keep_id), r.group_size) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    assert exact_dedup.exact_duplicates(empty).count() == 0


def test_line_windows(docs, empty):
    rows = {(r.doc_id, r.text) for r in docs.collect()}
    order = lambda r: (first(r[0]), exact[r])
    exact = {(r.doc_id, r.text): r.h for r in docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()}
    seen, want = set(), {}
    for r in sorted(rows, key=order):
        lines = [] if r[1] is None else r[1].split("\n")
        gone = set()
        for k in range(len(lines) - 2):
            w = tuple(lines[k : k + 3])
            gone |= {k, k + 1, k + 2} if w in seen else set()
            seen.add(w)
        kept = "\n".join(x for k, x in enumerate(lines) if k not in gone)
        want[r] = (len(lines), len(gone), r[1] if not gone else kept)
    got = line_dedup.dedup_lines(docs.withColumn("was", F.col("text"))).collect()
    assert len(got) == docs.count()
    assert all(want[(r.doc_id, r.was)] == (r.n_lines, r.n_removed, r.text) for r in got)
    assert sum(r.n_removed for r in got) > 0
    assert line_dedup.dedup_lines(empty).count() == 0


def test_repeated_passages(docs, empty):
    exact = {(r.doc_id, r.text): r.h for r in docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()}
    seen, want = set(), Counter()
    for (doc_id, text), _ in sorted(exact.items(), key=lambda x: (first(x[0][0]), x[1])):
        words, gone = WORD.findall(text or ""), set()
        for k in range(len(words) - 19):
            w = tuple(words[k : k + 20])
            gone |= set(range(k, k + 20)) if w in seen else set()
            seen.add(w)
        want[(doc_id, " ".join(w for k, w in enumerate(words) if k not in gone), len(words), len(gone))] += sum(r.doc_id == doc_id and r.text == text for r in docs.collect())
    got = Counter((r.doc_id, r.text, r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(docs).collect())
    assert got == want and sum(k[3] for k in want) > 100
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_word_hashes_agree_with_words(docs):
    raws = [(r.text or "").encode() for r in docs.collect()]
    known = {}
    for raw in raws:
        hashes = substring_dedup.word_hashes(raw)[1].tolist()
        assert len(hashes) == len(raw.split())
        assert all(known.setdefault(w, h) == h for w, h in zip(raw.split(), hashes))
    assert len(set(known.values())) == len(known)


def slow_simhash(text, n=3):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(words[k : k + n]).encode(), 42) for k in range(max(1, len(words) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def union(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def test_simhash(docs, empty):
    table = docs.collect()
    prints = {r.text: slow_simhash(r.text) for r in table}
    fps = sorted(set(prints.values()))
    root = union([(a, b) for a in fps for b in fps if a < b and bin(a ^ b).count("1") <= 3], fps)
    least = {}
    for r in table:
        if r.doc_id is not None:
            k = root[prints[r.text]]
            least[k] = min(least.get(k, r.doc_id), r.doc_id)
    want = sorted((first(r.doc_id), prints[r.text], first(least.get(root[prints[r.text]]))) for r in table)
    got = simhash.near_duplicates(docs).collect()
    assert sorted((first(r.doc_id), r.fp % (1 << 64), first(r.component_id)) for r in got) == want
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("tile", [2, 7, 2048])
def test_tiles_lose_no_link(spark, tile):
    random = np.random.default_rng(3)
    base = random.integers(0, 1 << 63, 12).tolist()
    fps = sorted({b ^ int(sum(1 << int(x) for x in random.choice(64, random.integers(0, 4), replace=False))) for b in base for _ in range(12)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.linked_fingerprints(spark.createDataFrame([(s,) for s in signed], "fp long"), tile=tile)
    got = {r.u: r.root for r in components.connected_components(links).collect()}
    want = union([(a, b) for a in signed for b in signed if a < b and bin((a ^ b) % (1 << 64)).count("1") <= 3], signed)
    assert {s: got.get(s, s) for s in signed} == want


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 150), (150, 180)]
    got = {r.u: r.root for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{k: 0 for k in range(1, 41)}, 101: 100, 200: 150, 180: 150}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_stars_need_no_round(spark, monkeypatch):
    written, write = [], components.materialise
    monkeypatch.setattr(components, "materialise", lambda *a: written.append(a) or write(*a))
    stars = [(k, k % 3) for k in range(3, 60)]
    assert sorted(map(tuple, components.connected_components(spark.createDataFrame(stars, "u long, v long")).collect())) == stars
    assert len(written) == 1
    odd = [(5, 1), (5, 1), (2, 6), (9, 8), (8, 7), (12, 10), (12, 11)]
    got = components.connected_components(spark.createDataFrame(odd, "u long, v long")).collect()
    assert sorted(map(tuple, got)) == [(5, 1), (6, 2), (8, 7), (9, 7), (11, 10), (12, 10)]


def test_filter_is_read_in_few_jobs_whatever_the_partitions(spark):
    keys = [k * 0x9E3779B97F4A7C15 % (1 << 64) for k in range(1, 3000)]
    signed = spark.createDataFrame([(k - (1 << 64) if k >> 63 else k,) for k in keys], "key long")
    before = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for c, x in zip(before, ("60", "false")):
            spark.conf.set(c, x)
        tracker = spark.sparkContext.statusTracker()
        known = set(tracker.getJobIdsForGroup())
        found = substring_dedup.Filter(signed, len(keys))
        assert len(set(tracker.getJobIdsForGroup()) - known) <= 4
    finally:
        for c, x in before.items():
            spark.conf.set(c, x)
    others = np.arange(1, 3000, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    assert found.has(np.array(keys, np.uint64)).all() and found.has(others).mean() < 0.2


def slow_hits(text, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    words, hit, names = split(text), set(), set()
    for name, item in items:
        w = split(item)
        for k in range(max(1, len(w) - 9) if w else 0):
            window = w[k : k + 10]
            for s in range(len(words) - len(window) + 1):
                if words[s : s + len(window)] == window:
                    hit |= set(range(s, s + len(window)))
                    names.add(name or "")
    return len(words), len(hit), sorted(names)


@pytest.mark.parametrize("block", [8 << 20, 60])
def test_decontamination(spark, docs, empty, block):
    texts = [r.text for r in docs.collect()]
    items = [("a", " ".join((texts[3] or "").split()[2:20])), ("b", (texts[8] or "")[:200]), ("c", "of of"), ("d", ""), (None, None), ("e", "w" * 3000), ("f", "same id"), ("a", "OTHER text")]
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id string, text string, n_words string")
    got = decontaminate.mark_contaminated(docs, bench, block_bytes=block).collect()
    for r in got:
        assert (r.n_words, sum(s.end - s.start for s in r.spans), r.items) == slow_hits(r.text, items)
    assert sum(bool(r.spans) for r in got) >= 4
    assert decontaminate.mark_contaminated(empty, bench).count() == 0
    assert decontaminate.mark_contaminated(docs, bench.limit(0)).where("size(spans) > 0").count() == 0


def test_blocks_write_marks_and_no_documents(spark, docs, tmp_path, monkeypatch):
    """Ten blocks and more: what they write stays far below one copy of the documents."""
    texts = [r.text or "" for r in docs.orderBy("doc_id").collect()]
    copied = next(r for r in docs.orderBy("doc_id").collect() if r.doc_id is not None and len((r.text or "").split()) > 60)
    items = [(f"i{k}", " ".join(texts[k].split()[4:40])) for k in range(40)] + [("j", texts[9] + " more"), ("long", copied.text)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    hot = docs.unionByName(docs.where(F.col("doc_id") == copied.doc_id).limit(1).withColumn("doc_id", F.explode(F.sequence(F.lit(1000), F.lit(1100)))))
    clean = spark.range(2000, 2200).select(F.col("id").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(3000)), lambda k: F.hex(F.xxhash64("id", k))), " ").alias("text"))
    hot = hot.unionByName(clean, allowMissingColumns=True).repartition(4).cache()
    sizes, write = [], decontaminate.materialise

    def weigh(df, label, folder=None):
        got = write(df, label, folder)
        sizes.append((label, sum(f.stat().st_size for f in tmp_path.rglob("*.parquet"))))
        return got

    monkeypatch.setattr(decontaminate, "materialise", weigh)
    monkeypatch.setattr(decontaminate, "scratch_dir", lambda _, label: f"file://{tmp_path}/{label}")
    total = sum(len(t.encode()) for _, t in set(items))
    got = decontaminate.mark_contaminated(hot.withColumn("digest", F.lit("clash")), bench, block_bytes=total // 12).collect()
    assert sum(label.startswith("block=") for label, _ in sizes) >= 10 and sizes[-1][0] == "marked-texts"
    assert not list(tmp_path.rglob("block=*")) and len(got) == hot.count()
    one = Counter((r.doc_id, r.text, r.n_words, str(r.spans), str(r.items)) for r in decontaminate.mark_contaminated(hot, bench).collect())
    assert Counter((r.doc_id, r.text, r.n_words, str(r.spans), str(r["items"])) for r in got) == one
    assert all(r.digest == "clash" for r in got) and sum(bool(r.spans) for r in got) > 100
    # Each block writes some kilobytes; one copy of the texts would be 10 MB.
    assert max(size for _, size in sizes) < hot.agg(F.sum(F.octet_length("text"))).first()[0] / 50
    hot.unpersist()


def test_token_records(docs, empty):
    path = token_records.default_tokenizer()
    got = sorted(token_records.encoded_documents(docs, path).collect(), key=lambda r: r.start)
    coder = token_records.Encoder(path)
    want = Counter()
    for r in docs.collect():
        ids = np.array(coder.tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4")
        want[(r.doc_id, len(ids), zlib.crc32(ids.tobytes()))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert [first(r.doc_id) for r in got] == sorted(first(r.doc_id) for r in got)
    assert token_records.encoded_documents(empty, path).count() == 0


def test_encoder_cuts_like_the_tokenizer():
    coder = token_records.Encoder(token_records.default_tokenizer(), most=20)
    texts = ["", " ", "a  b", "\na", "a \nb", "a\n b", "a\r\nb", "x, y!! z%%% a's don't 'll O.K.", "\0a \0", "日本 語です", "a\x1cb \xa0 c　d", "<|endoftext|> x", "1,2 3.4 (5)"]
    for _ in range(3):
        got = coder.encode(texts)
    assert got == [np.array(coder.tokenizer.encode(t, add_special_tokens=False).ids, coder.dtype).tobytes() for t in texts]


def test_records_notice_damage():
    record = bytearray(token_records.frame(b"some data"))
    assert token_records.unframe(record) == (b"some data", len(record))
    for k in range(len(record)):
        broken = bytearray(record)
        broken[k] ^= 1
        with pytest.raises(ValueError):
            token_records.unframe(broken)


def test_archives(spark):
    html = ["<p>ä</p>" * 200, "short", "<p>ä</p>" * 200, None, "", "short", "x" * 999, "x" * 999, "y" * 1000, "y" * 1000, "z\r\n\r\n" * 300]
    rows = [(k, f"http://x/{k}\r\nEvil: 1" if k else None, h, "clash") for k, h in enumerate(html)] + [(9, "http://again", "y" * 1000, "c"), (None, "u", "y" * 1000, "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(3)
    got = Counter(tuple(r) for r in warc.archived_pages(pages).collect())
    want = Counter()
    for k, _, h, _ in rows:
        raw = (h or "").encode()
        keep = max(first(r[0]) for r in rows if (r[2] or "") == (h or ""))[1]
        other = len(raw) >= 1000 and k != keep
        want[(k, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if other else "response", keep if other else None)] += 1
    assert got == want
    assert warc.archived_pages(pages.limit(0)).count() == 0
    long = spark.createDataFrame([(k, "u", chr(97 + k) * 3_000_000) for k in range(4)], "page_id long, url string, html string")
    back = warc.read_archives(warc.write_archives(warc.plan_records(long)), request_bytes=4_000_000).collect()
    assert sorted(bytes(r.payload).decode() for r in back) == sorted(r.html for r in long.collect())
    index = warc.write_archives(warc.plan_records(pages))
    some = warc.read_archives(index.where("url = 'http://again'")).collect()
    assert [bytes(r.payload) for r in some if r.payload is not None] == [b"y" * 1000]


def test_raking_meets_marginals(docs, empty):
    cells = [("a", "x", "p", 100), ("a", "y", "p", 50), ("b", "x", "q", 30), ("b", "y", "p", 20), ("a", "x", "q", 10), ("b", "y", "q", 5)]
    targets = {"source": {"a": 0.5, "b": 0.5}, "lang": {"x": 0.6, "y": 0.4}, "topic": {"p": 0.7, "q": 0.3}}
    weights = mixing.rake(cells, targets, 300)
    for k, d in enumerate(mixing.DIMENSIONS):
        for v, share in targets[d].items():
            assert abs(sum(w for c, w in zip(cells, weights) if c[k] == v) / 215 - share) < 1e-6
    p = mixing.calibrate(cells, weights, 0.4)
    assert abs(sum(c[-1] * x for c, x in zip(cells, p)) - 86) < 1e-6 and max(p) <= 1
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count() and all(0 <= r.probability <= 1 for r in got)
    assert mixing.mix(empty).count() == 0


@pytest.mark.parametrize("given", ["tempered", "dict", "table"])
def test_raking_on_tables_is_the_same(spark, docs, given):
    """Whatever form the cells take; some cells are sampled whole."""
    targets = {"source": {"s0": 0.3, "s1": 0.5, "": 0.2}, "lang": {"en": 0.6, "de": 0.3, "": 0.1}, "topic": {t: 1 / 6 for t in ("empty", "table", "loud", "numbers", "short", "prose")}}
    targets = {"tempered": None, "dict": targets, "table": mixing._targets_table(spark, targets)}[given]
    one = {(r.doc_id, r.text): r.probability for r in mixing.mix(docs, 0.7, 3, targets=targets).collect()}
    two = {(r.doc_id, r.text): r.probability for r in mixing.mix(docs, 0.7, 3, targets=targets, most_cells=0).collect()}
    assert all(abs(one[k] - two[k]) < 1e-8 for k in one) and len({round(p, 6) for p in one.values()}) > 3


def test_mixture_reaches_its_targets(spark):
    rows = [(k, "w " * (1 + k % 9), "ab"[k % 2], "xy"[k % 3 == 0], "pq"[k % 5 == 0]) for k in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, topic string")
    targets = {"source": {"a": 0.4, "b": 0.6}, "lang": {"x": 0.7, "y": 0.3}, "topic": {"p": 0.75, "q": 0.25}}
    got = {(r.dimension, r.value): r.share for r in mixing.reached_shares(mixing.mix(table, 0.1, targets=targets)).collect()}
    assert all(abs(got[d, v] - s) < 1e-5 for d, shares in targets.items() for v, s in shares.items())


def test_quality_learns_and_keeps_its_hands_off(spark, docs, empty):
    good = [f"This is a calm sentence about item {k}, which reads well and ends here." for k in range(150)]
    bad = [f"BUY!! NOW!! {k} | | %%% $$$ ###" for k in range(150)]
    rows = [(k, t) for k, t in enumerate(x for p in zip(good, bad) for x in p)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1 - k % 2, 0) for k, _ in rows] + [(5, 1, 0), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.train_quality(d, labels)
    held = quality.score_quality(d, model).where(quality.held_out(F.col("doc_id"))).collect()
    assert len(held) > 50 and all((r.score >= 0.5) == (r.doc_id % 2 == 0) for r in held)
    got = quality.score_quality(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert quality.score_quality(empty, model).count() == 0
    again = d.unionByName(d.where("doc_id = 4").crossJoin(spark.range(300)).select("doc_id", F.lit("zz | !!").alias("text")))
    assert np.allclose(quality.train_quality(again, labels).linear, model.linear)
    prior = quality.train_quality(d, labels.limit(0))
    assert {r.score for r in quality.score_quality(docs, prior).collect()} == {0.5}
    part = quality.features("a b a", quality._Slots())
    assert abs(float((part[1] ** 2).sum()) - 1) < 1e-6


def test_factorisation_identity():
    random = np.random.default_rng(1)
    model = quality.Model(np.zeros((quality.N_STATS, quality.BINS)), 0.3, random.normal(size=quality.FEATURES), random.normal(size=(quality.FEATURES, 4)))
    starts, at, x = np.array([0, 3]), np.array([1, 5, 9, 2, 3]), random.normal(size=5)
    for row, part in zip(model.logit(starts, at, x), (slice(0, 3), slice(3, 5))):
        i, v = at[part], x[part]
        pairs = sum(model.factors[i[a]] @ model.factors[i[b]] * v[a] * v[b] for a in range(len(i)) for b in range(a))
        assert abs(row - (0.3 + model.linear[i] @ v + pairs)) < 1e-9


def test_repeats_reach_python_in_small_batches(spark, monkeypatch):
    """Whoever reads op7's result, the texts were handed to Python by the helper: the result is a written table."""
    found = []
    monkeypatch.setattr(substring_dedup, "materialise", lambda df, label, *a: found.append(label) or shared_materialise(df, label, *a))
    got = substring_dedup.op7_repeated_phrase_automata(spark, "/root/testdata/sf0.001")
    assert found[-1] == "repeats-removed" and got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert "MapInArrow" not in got._jdf.queryExecution().toString() and got.count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
