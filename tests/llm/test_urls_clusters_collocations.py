"""URL rules, integer clusters and phrase collocations against brute force and on odd rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from docscreen.llm import clusters, collocations, urls

# op11

ODD_URLS = [
    None, "", "no scheme", "//x.com/", "com/", "http://", "http:///en/", "http://com", "http://com/", "http://COM/",
    "http://a.com/x", "http://a.com", "http://a.com?x", "http://acom/", "http://a.com./", "http://example.com/en/",
    "http://EXAMPLE.com/en/1", "http://example.com/EN/1", "http://www.example.com/en/2", "http://blog.www.example.com/en/",
    "http://myexample.com/en/", "http://example.com/en", "http://x.net/es/1", "https://x.net/es", "http://x.net/fr/?q",
    "ftp://y.net/fr/a#b://c", "http://net/fr/", "http://a.b://c.net/es/", "http://x.net:80/es/", "http://Ünï.com/",
    "http://x.org/a/banners/b", "http://x.org/bannersx/", "http://x.org/f.exe", "http://x.org/f.exe?a", "http://x.org/?sessionid=1",
    "http://casino-win.example.org/", "http://mycasino.example.org/", "http://a.casino9.example.org/", "http://adserver/",
    "http://x.org/adserver", "http://x.org/adservers", "http://x.org/track/a/b/click?", "http://x.org/line\nbreak/banners/",
    "http://archive.org/banners/", "http://x.org/robots.txt", "http://x.org/" + "a/" * 20_000 + "banners/",
]


def judged_by_force(url, rules):
    """Host, path and the first rule that fits, by trying all of them."""
    host = path = ""
    line = ":" + (url or "")
    if url is not None and "://" in url:
        after = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", after).group()
        path = re.match(r"[^?#]*", after[len(host):]).group()
        host, line = host.translate(urls._LOWER), "//" + host.translate(urls._LOWER) + after[len(host):]
    for r in rules:
        if r.site:
            own_host, _, own_path = r.text.partition("/")
            if url is not None and "://" in url and (host == own_host or host.endswith("." + own_host)) \
                    and path.startswith("/" + own_path):
                return host, path, r
        elif re.search(r.regex(), line):
            return host, path, r
    return host, path, None


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i if i else None, u, "x", "y", i) for i, u in enumerate(ODD_URLS)] + [(7, ODD_URLS[9], "x", "y", 1)]
    return spark.createDataFrame(rows, "page_id long, url string, host string, rule string, line int").repartition(3)


def as_rows(frame):
    return sorted((str(r.page_id), r.host, r.path, r.rule, r.verdict, r.pattern) for r in frame.collect())


def test_urls_equal_trying_all_rules(pages):
    rules = urls.rules_of()
    expected = []
    for r in pages.collect():
        host, path, rule = judged_by_force(r.url, rules)
        expected.append((str(r.page_id), host, path, rule.text if rule and rule.site else None,
                         rule.action if rule else "allow", rule.text if rule and not rule.site else None))
    assert as_rows(urls.judge(pages)) == sorted(expected)
    assert as_rows(urls.judge(pages, index_bytes=0)) == sorted(expected)


def test_url_contract_cases(spark):
    asked = {"http://www.example.com/en/1": ("www.example.com/en/", "allow"), "http://m.example.com/en/": ("example.com/en/", "block"),
             "http://example.com/fr/": ("com/", "allow"), "http://q.net/es/": ("net/es/", "block"), "http://q.net/es": (None, "allow"),
             "http://q.org/": (None, "allow")}
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(asked)], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge(rows).collect()}
    assert [got[i] for i in range(len(asked))] == list(asked.values())
    assert urls.judge(rows.limit(0)).count() == 0


def test_rules_are_filed_under_their_rarest_token(spark):
    rules = urls.rules_of((("block", "example.com/en/"),), (("block", "/rare/common/"), ("block", "mon/"), ("block", "*x*")))
    assert [r.tokens() for r in rules] == [["com", "en", "example"], ["common", "rare"], [], []]
    lines = urls.prepared(spark.createDataFrame(
        [(i, "http://a.com/en/common/" + ("rare/" if i == 3 else "")) for i in range(9)], "page_id long, url string"))
    counts = urls.token_counts(lines, rules)
    assert counts == {"com": 9, "en": 9, "example": 0, "common": 9, "rare": 1}
    tokens = urls.filed(rules, counts)
    assert tokens == ["example", "rare", None, None]
    ran = []
    index = urls.index_of(rules, tokens)
    urls.deciding("//a.com/en/common/", index, rules, [r.regex() for r in rules], ran)
    assert ran == [2]  # a rule without a token; it fits, so nothing after it runs
    ran = []
    urls.deciding("//a.com/en/cold", index, rules, [r.regex() for r in rules], ran)
    assert set(ran) <= {2, 3}


# op12

def nearest_by_force(vectors, centroids):
    d = ((vectors[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    return d.argmin(axis=1), d.min(axis=1)


@pytest.mark.parametrize("size, spread", [(1, 50), (2, 3), (5, 1), (40, 4), (40, 1), (133, 90)])
def test_tree_search_equals_comparing_all(size, spread):
    rng = np.random.default_rng(size * spread)
    centroids = rng.integers(-spread, spread + 1, (size, 6))
    centroids[size // 2] = centroids[0]  # equal centroids: the smaller number wins
    vectors = np.concatenate([rng.integers(-2 * spread, 2 * spread + 1, (500, 6)), centroids,
                              (centroids[rng.integers(0, size, 50)] + centroids[rng.integers(0, size, 50)]) // 2])
    number, distance = clusters.search(clusters.build(centroids), vectors)
    expected = nearest_by_force(vectors, centroids)
    assert number.tolist() == expected[0].tolist() and distance.tolist() == expected[1].tolist()


def test_tree_search_leaves_subtrees_out():
    rng = np.random.default_rng(0)
    centroids = rng.integers(-1000, 1000, (200, 2))
    visited = []
    clusters.search(clusters.build(centroids), rng.integers(-1000, 1000, (300, 2)), visited)
    assert sum(visited) < 0.35 * 300 * 200
    big = np.full((2, 64), clusters.LIMIT - 1)
    big[1] = -big[0]
    assert clusters.search(clusters.build(big), -big)[1].tolist() == [0, 0]
    assert int(clusters.squared(big[0], big[1])) == 64 * (2 * (clusters.LIMIT - 1)) ** 2


def clusters_by_force(rows, k, rounds, dim):
    kept = [(i, [int(np.floor(float(np.float32(x)) * clusters.SCALE)) for x in v]) for i, v in rows
            if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    seed = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(kept, key=seed)[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        found = assign()
        for j in range(len(centroids)):
            own = [v for (_, v), (_, at) in zip(kept, found) if at == j]
            if own:
                centroids[j] = [sum(c) // len(own) for c in zip(*own)]
    return sorted((str(i), at, d) for (i, _), (d, at) in zip(kept, assign())), centroids


def test_clusters_equal_plain_rounds(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((7, 4))
    rows = [(i, (base[i % 7] + 0.3 * rng.standard_normal(4)).astype(np.float32).tolist()) for i in range(160)]
    rows += [(500 + i, rows[0][1]) for i in range(60)] + [(3, rows[3][1]), (None, rows[5][1]), (4, rows[9][1])]
    rows += [(900, None), (901, []), (902, [1.0] * 3), (903, [float("nan")] * 4), (904, [float("inf")] * 4),
             (905, [None, 1.0, 1.0, 1.0]), (906, [-0.001, 0.0, 0.5, -1.0])]
    table = spark.createDataFrame([(i, v, "c", 1) for i, v in rows], "vec_id long, embedding array<float>, cluster string, v int")
    for k in (9, 400):
        found, centroids = clusters.cluster(table.repartition(4), k=k, rounds=3, dim=4)
        got = sorted((str(r.vec_id), r.cluster, r.distance) for r in found.collect())
        expected, middles = clusters_by_force(rows, k, 3, 4)
        assert got == expected and centroids.tolist() == middles
    found, centroids = clusters.cluster(table.limit(0), dim=4)
    assert found.count() == 0 and len(centroids) == 0
    with pytest.raises(Exception, match="after scaling"):
        clusters.cluster(spark.createDataFrame([(1, [1e9] * 4)], "vec_id long, embedding array<float>"), dim=4)


# op13

def collocations_by_force(rows, min_count, longest, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = (text or "").translate(urls._LOWER)
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for m in range(1, longest + 1):
                f[lang].update(tuple(words[i:i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, own in f.items():
        often = {p: a for p, a in own.items() if a >= min_count and len(p) > 1}
        rows = []
        for p, a in often.items():
            if any(len(q) > len(p) and 100 * b >= 100 * a
                   and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in often.items()):
                continue
            score, k = min((1000 * a * n[lang] // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            rows.append((score, a, " ".join(p), own[p[:k]], own[p[k:]]))
        rows.sort(key=lambda r: (-r[0], -r[1], r[2].encode()))
        out += [(lang, i + 1, p, a, x, y, n[lang], s) for i, (s, a, p, x, y) in enumerate(rows[:top])]
    return sorted(out)


def phrase_rows():
    random.seed(8)
    words = ["ka", "lo", "Mi", "é", "the", "of", "x-1", "ß", "A", "zu", "New", "York"]
    rows = [(None, None), (None, ""), ("und", "a b a b a b"), (None, "a b A B"), ("en", " \t ,;"), ("en", "one")]
    for i in range(400):
        text = ""
        for _ in range(random.randrange(1, 30)):
            text += random.choice(words[: 3 + i % 10]) + random.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "! "])
        rows.append((["en", "en", "fr", None][i % 4], text))
    rows += [("en", "in the city of New York and beyond")] * 30 + [("de", "same " * 3000)]
    return rows


@pytest.fixture(scope="module")
def phrases(spark):
    return spark.createDataFrame([(i % 50, t, lang, "q", 1) for i, (lang, t) in enumerate(phrase_rows())],
                                 "doc_id long, text string, lang string, word string, n int").repartition(5).cache()


def table(frame):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in frame.collect())


def test_collocations_equal_plain_counting(phrases):
    expected = collocations_by_force(phrase_rows(), 4, 5, 60)
    assert len({r[0] for r in expected}) == 4
    assert table(collocations.collocations(phrases, min_count=4, top=60)) == expected


def test_collocations_with_a_joined_dictionary_and_small_filters(phrases, monkeypatch):
    monkeypatch.setattr(collocations, "BLOCK_PLACES", 64)
    expected = collocations_by_force(phrase_rows(), 6, 3, 2000)
    assert table(collocations.collocations(phrases, 6, 3, dictionary_bytes=0)) == expected


def test_collocations_of_nothing(phrases):
    assert collocations.collocations(phrases.limit(0)).count() == 0
    assert collocations.collocations(phrases, min_count=10**6).count() == 0


@pytest.mark.parametrize("n, bits", [(2, 1), (2, 5), (3, 13), (4, 16), (5, 13), (5, 25)])
def test_permutation_is_invertible_and_filters_lose_nothing(n, bits):
    rng = np.random.default_rng(n * bits)
    ids = rng.integers(1, 1 << bits, 3000).astype(np.int32)
    at = np.arange(len(ids) - n + 1)
    high, low = collocations.pack(ids, at, n, bits)
    width = n * bits
    lead, rest = collocations.permute(high, low, width)
    back = collocations.unpack(*collocations.restore(lead, rest, width), n, bits)
    assert (back == np.stack([ids[at + i] for i in range(n)], axis=1)).all()
    lead, rest, count = collocations.summed(lead, rest, None, width)
    count = count * rng.choice([1, 200, 10**12], len(count))
    assert len(lead) == len({tuple(x) for x in back.tolist()})
    block_bits = min(3, width - 1)
    block = lead >> np.uint64(min(width, 64) - block_bits)
    for b in np.unique(block).tolist():
        own = block == b
        row = collocations.encode_block(lead[own], rest[own], count[own], width, block_bits)
        again = collocations.decode_block(b, row, width, block_bits)
        assert all((x == y[own]).all() for x, y in zip(again, (lead, rest, count), strict=True))


def test_small_widths_are_permuted_onto_themselves():
    for width in range(2, 13):
        x = np.arange(1 << width, dtype=np.uint64)
        assert sorted(collocations.permute(x * 0, x, width)[0].tolist()) == x.tolist()


def test_counts_over_many_filters(spark, monkeypatch):
    """Filters of several tasks and portions of a task add up."""
    monkeypatch.setattr(collocations, "FILTER_PLACES", 500)
    rng = np.random.default_rng(2)
    lists = [rng.integers(0, 7, 900).tolist() for _ in range(12)]
    coded = spark.createDataFrame([(x,) for x in lists], "ids array<int>").repartition(4)
    got = {tuple(r.ids): r.a for r in collocations.count_phrases(coded, 2, 3, 20, 900 * 12).collect()}
    expected = Counter(p for x in lists for p in zip(x, x[1:]) if all(p))
    assert got == {p: a for p, a in expected.items() if a >= 20}
