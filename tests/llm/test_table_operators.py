"""Operators that compare rows with one another, against brute force."""

import hashlib
import random
import time
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from solekey.llm import components, decontaminate, embeddings, line_dedup, simhash, url_rules

DOCS = "doc_id long, text string, fingerprint string, component_id int, digest string, owner string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "f", 1, "d", "o") for i, t in rows], DOCS)


def words(rng, n, size=3000):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def groups_of(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(400 + i, 401 + i) for i in range(60)]
    edges += [(900, i) for i in range(1000, 1200)] + [(7, 7)]
    found = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    expected = groups_of(1200, edges)
    ends = {x for a, b in edges if a != b for x in (a, b)}
    assert found == {x: expected[x] for x in ends}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_ring_keeps_every_near_pair():
    rng = random.Random(2)
    for bits in (1, 2, 3, 4):
        flips = [sum(1 << b for b in rng.sample(range(64), rng.randint(0, bits))) for _ in range(3000)]
        assert simhash.within(np.array(flips, np.uint64), bits).all()
        far = [sum(1 << b for b in rng.sample(range(64), bits + 1)) for _ in range(500)]
        assert not simhash.within(np.array(far, np.uint64), bits).any()


def test_bucket_searches_agree():
    rng = random.Random(3)
    values = {rng.getrandbits(64)}
    while len(values) < 200:
        base = rng.choice(sorted(values)) if rng.random() < 0.9 else rng.getrandbits(64)
        values.add(base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3))))
    values = np.array(sorted(values), np.uint64)
    at = {int(v): i for i, v in enumerate(values)}
    near = [(i, j) for i in range(200) for j in range(i) if int(values[i] ^ values[j]).bit_count() <= 2]
    for search in (simhash._bucket_tree, simhash._bucket_by_flips):
        linked = [(at[int(a)], at[int(b)]) for x, y in search(values, 2) for a, b in zip(x, y)]
        assert groups_of(200, linked) == groups_of(200, near)


def test_simhash_groups_against_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for i in range(60):
        text = words(rng, rng.randint(1, 400))
        for copy in range(rng.choice([1, 1, 2, 14])):
            own = list(text)
            for _ in range(rng.randint(0, 2)):
                own[rng.randrange(len(own))] = f"W{rng.randrange(3000)}"
            rows.append((len(rows), " ".join(own)))
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "one two"), (1004, "ONE\ttwo"), (1003, "one two"), (1005, "x " * 50_000)]
    found = simhash.simhash_groups(documents(spark, [*rows, (None, "one two"), (None, "alone without id")]))
    got = found.where("doc_id IS NOT NULL").collect()
    prints = [simhash.fingerprint(t or "") for _, t in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    root = groups_of(len(rows), near)
    least = defaultdict(lambda: 10**9)
    for i, (doc, _) in enumerate(rows):
        least[root[i]] = min(least[root[i]], doc)
    expected = sorted((doc, prints[i] - (1 << 64) * (prints[i] >> 63), least[root[i]]) for i, (doc, _) in enumerate(rows))
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == expected
    assert {r.component_id for r in found.where("doc_id IS NULL").collect()} == {1003, None}
    assert prints[-7] == 0 and len(got) == len(rows)
    docs = documents(spark, [*rows, (None, "one two")])
    kept = simhash.simhash_dedup(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids == sorted(set(least.values())) and kept.where("doc_id IS NULL").count() == 1
    assert simhash.simhash_groups(docs.limit(0)).count() == 0


def test_fingerprint_is_the_majority_of_hashes(spark):
    text = "A b c d e b c d"
    own = text.lower().split()
    hashes = [
        r[0] % (1 << 64)
        for r in spark.createDataFrame([(" ".join(own[i : i + 3]),) for i in range(6)], "s string").select(F.xxhash64("s")).collect()
    ]
    assert simhash.fingerprint(text) == sum((sum(h >> b & 1 for h in hashes) > 3) << b for b in range(64))


def plain_lines(rows, min_docs=5):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(lower)

    held = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 40:
                held[key(line)].add(doc)
    keeper = {k: max(x for x in v if x is not None) for k, v in held.items() if len(v) >= min_docs}
    for doc, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if key(x) not in keeper or keeper[key(x)] == doc]
        yield doc, len(lines), len(lines) - len(stay), "\n".join(stay)


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(5)
    common = ["A common line that many documents hold, number %d" % i for i in range(12)] + ["é" * 39, "É" * 40, "short"]
    rows = []
    for i in range(80):
        lines = [rng.choice(["", " ", "\t"]) + rng.choice([x, x.upper(), x]) + " " for x in rng.sample(common, rng.randint(0, 5))]
        lines += [f"own line of document {i} that nobody else has, at all {k}" for k in range(rng.randint(0, 4))]
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines * rng.choice([1, 1, 2]))))
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, (common[0] + "\n") * 20_000), (5, rows[5][1]), (None, common[1]), (None, common[1])]
    docs = documents(spark, rows)
    got = line_dedup.drop_repeated_lines(docs, 40, 5, "owner")
    seen = [(r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got.collect()]
    assert sorted(seen, key=repr) == sorted(plain_lines(rows), key=repr)
    assert {r.owner for r in got.collect()} == {"o"}
    assert line_dedup.drop_repeated_lines(docs.limit(0)).count() == 0


def test_lines_too_many_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", 0)
    test_line_dedup_against_brute_force(spark)


def test_candidates_too_many_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_IDS", 0)
    test_decontamination_against_brute_force(spark)


def test_full_filters_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "MOST_BITS", line_dedup.LEAST_BITS)
    rows = [(i, "\n".join(f"line {k % (i + 3)} of a text that is long enough to count" for k in range(40))) for i in range(30)]
    got = line_dedup.drop_repeated_lines(documents(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got) == sorted(plain_lines(rows))


def test_second_filter_holds_every_repeat(spark):
    rows = [(i, "\n".join(f"line {k} of a text that is long enough to count" for k in range(i, i + 3))) for i in range(40)]
    once, twice = line_dedup.bloom_filters(documents(spark, rows), 1 << 16)
    bits = np.unpackbits(np.frombuffer(twice, np.uint8))
    import xxhash

    for k in range(1, 40):
        hashed = xxhash.xxh64_intdigest(f"line {max(k, 1)} of a text that is long enough to count".encode())
        if k >= 1 and k < 40:
            assert bits[line_dedup.positions(np.array([hashed], np.uint64), 1 << 16).astype(int).ravel()].all()
    assert hashlib.sha256(once).digest() != hashlib.sha256(twice).digest()


def test_decontamination_against_brute_force(spark):
    rng = random.Random(6)
    items = [(i, " ".join(words(rng, rng.randint(6, 120)))) for i in range(40)]
    items += [(100, None), (101, ""), (102, "too short"), (103, "five words are just enough")]
    rows = []
    for i in range(200):
        body = words(rng, rng.choice([5, 50, 3000]))
        if i % 4 == 0:
            item = items[rng.randrange(40)][1].split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                item[rng.randrange(len(item))] = "changed"
            at = rng.randrange(len(body))
            body[at:at] = [x.upper() for x in item]
        rows.append((i, "\n".join(body)))
    rows += [(300, None), (301, ""), (302, "a Five  words are just enough b"), (0, rows[0][1])]
    docs = documents(spark, rows)
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, sketch string")
    expected = []
    for doc, text in rows:
        own = set(decontaminate.shingles(text))
        for item, wanted in items:
            wanted = set(decontaminate.shingles(wanted))
            if wanted and len(own & wanted) >= 0.8 * len(wanted):
                expected.append((doc, item, len(wanted), len(own & wanted)))
    got = [(r.doc_id, r.item_id, r.n_item, r.n_shared) for r in decontaminate.find_contained(docs, bench).collect()]
    assert sorted(got) == sorted(expected) and len(expected) > 30
    kept = decontaminate.remove_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in rows} - {e[0] for e in expected}
    assert decontaminate.find_contained(docs, bench.limit(0)).count() == 0
    assert decontaminate.find_contained(docs.limit(0), bench).count() == 0


def test_items_of_few_shingles_are_never_missed(spark):
    rng = random.Random(12)
    items = [(i, " ".join(words(rng, 5 + (i % 4 if i >= 600 else 0), 10**6))) for i in range(700)]
    rows = []
    for i, (_, item) in enumerate(items):
        body = words(rng, 200)
        at = rng.randrange(20, 180)
        rows.append((i, " ".join([*body[:at], *item.split(), *body[at:]])))
    bench = spark.createDataFrame([*items, (900, " ".join(words(rng, 30)))], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.n_item, r.n_shared) for r in decontaminate.find_contained(documents(spark, rows), bench).collect()}
    sizes = [len(text.split()) - 4 for _, text in items]
    assert got == {(i, i, n, n) for i, n in enumerate(sizes)}


def test_near_vectors_against_brute_force(spark):
    rng = np.random.default_rng(7)
    rows = [x / np.linalg.norm(x) for x in rng.standard_normal((300, 16))]
    for i in range(60):
        for _ in range(4):
            rows.append(rows[i] * 3 + 0.3 * rng.standard_normal(16) / 4)
    rows += [rows[0]] * 50
    table = [(i, [float(np.float32(v)) for v in x], "c") for i, x in enumerate(rows)]
    odd = [(900, None, ""), (901, [], ""), (902, [0.0] * 16, ""), (903, [None] + [1.0] * 15, ""), (904, [float("nan")] * 16, "")]
    odd += [(905, [float("inf")] * 16, ""), (906, [1.0, 2.0], ""), (907, [2.0, 4.0], ""), (None, [1.0, 2.0], ""), (3, table[3][1], "")]
    vectors = spark.createDataFrame([*table, *odd], "vec_id long, embedding array<float>, component string")
    got = embeddings.near_duplicates(vectors).collect()
    assert len(got) == len(table) + len(odd)
    by_id = {r.vec_id: r for r in got}
    own = [np.array(x[1]) for x in table] + [np.array(table[3][1])]
    unit = np.stack([x / np.linalg.norm(x) for x in own])
    near = unit @ unit.T >= 0.95
    links = near.sum(1) - 1
    found = sum(by_id[i].n_links for i in range(len(table)))
    assert found >= 0.9 * links[:-1].sum()
    assert all(by_id[i].n_links <= links[i] for i in range(len(table)))
    for i in (900, 901, 902, 903, 904, 905):
        assert (by_id[i].n_links, by_id[i].component_id, by_id[i].kept) == (0, i, True)
    assert by_id[906].n_links == by_id[907].n_links == 2 and by_id[907].component_id == 906 and not by_id[907].kept
    assert by_id[len(table) - 1].component_id == 0
    assert embeddings.near_duplicates(vectors.limit(0)).count() == 0


def test_split_cells_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(i, [1.0 + 0.02 * float(v) for v in rng.standard_normal(8)]) for i in range(200)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {r.vec_id: r for r in embeddings.near_duplicates(vectors).collect()}
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    monkeypatch.setattr(embeddings, "VISITORS", 24)
    split = {r.vec_id: r for r in embeddings.near_duplicates(vectors).collect()}
    assert whole == split and all(r.component_id == 0 for r in whole.values())
    assert sum(r.n_links for r in whole.values()) >= 0.95 * 199 * 200


RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def plain_verdict(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url[url.index("://") + 3 :]
    cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    host, path = rest[:cut], rest[cut:]
    path = path[: min([i for i in map(path.find, "?#") if i >= 0], default=len(path))]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[1], max(fits)[2]) if fits else (host, path, None, "allow")


def test_url_rules(spark):
    urls = [None, "", "x", "http://", "http:///es/", "HTTP://Example.ORG/es/x?y", "http://a.example.org/en/12#q", "http://a..org/"]
    urls += ["http://org", "http://org/", "http://é.com/fr/", "http://com?x", "://com/de/://org/", "http://a.example.org?/es/"]
    urls += ["http://x.org#f/", "http://example.org:80/es/", "http://xexample.org/es/", "http://.com/de/1", "http://org/" + "a/" * 20_000]
    rows = [*enumerate(urls), (5, urls[5]), (5, urls[5]), (3, "http://a.org/"), (None, "http://org/es"), (None, None)]
    rows += [(1000 + i, f"http://w{i % 7}.example.org/e{'ns'[i % 2]}/{i}") for i in range(300)]
    pages = spark.createDataFrame([(i, u, "k", "c") for i, u in rows], "page_id long, url string, key string, chain string")
    rules = spark.createDataFrame([*RULES, ("block", None, "/")], "verdict string, host string, path string")
    got = [tuple(r) for r in url_rules.judge(pages, rules).collect()]
    assert sorted(got, key=repr) == sorted(((i, *plain_verdict(u)) for i, u in rows), key=repr)
    assert url_rules.judge(pages.limit(0), rules).count() == 0
    assert {r.rule for r in url_rules.judge(pages, rules.limit(0)).collect()} == {None}


def test_very_long_urls(spark):
    rules = spark.createDataFrame([("block", "org", "/a"), ("allow", "x.org", "/aa"), ("block", "y", "")], "verdict string, host string, path string")
    urls = [
        "http://x.org/" + "a" * 1_000_000,
        "http://" + "a." * 200_000 + "x.org/ab",
        "http://" + "b" * 1_000_000 + ".org/b",
        "http://y" + "y" * 1_000_000,
        "http://sub.y?" + "q" * 1_000_000,
    ]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls * 3)], "page_id long, url string")
    began = time.monotonic()
    got = {r.page_id: (r.rule, r.verdict) for r in url_rules.judge(pages, rules).select("page_id", "rule", "verdict").collect()}
    one = [("x.org/aa", "allow"), ("org/a", "block"), (None, "allow"), (None, "allow"), ("y", "block")]
    assert got == dict(enumerate(one * 3))
    assert time.monotonic() - began < 120


def test_many_nested_rules(spark):
    rng = random.Random(11)
    hosts = ["a", "b.a", "c.b.a", "d", "b.d"]
    rules = {(rng.choice(hosts), "/" + "".join(rng.choice("xy/") for _ in range(rng.randint(0, 5)))): rng.choice(["allow", "block"]) for _ in range(120)}
    urls = [(i, f"s://{rng.choice(hosts)}/" + "".join(rng.choice("xy/") for _ in range(rng.randint(0, 7)))) for i in range(400)]
    table = spark.createDataFrame([(h, p, v) for (h, p), v in rules.items()], "host string, path string, verdict string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_rules.judge(spark.createDataFrame(urls, "page_id long, url string"), table).collect()}
    for i, url in urls:
        host, path = url[4:].split("/", 1)
        fits = [(len(h + p), ".".join(h.split(".")[::-1]) + p, h + p, v) for (h, p), v in rules.items() if (host == h or host.endswith("." + h)) and ("/" + path).startswith(p)]
        assert got[i] == (max(fits)[2:] if fits else (None, "allow"))
