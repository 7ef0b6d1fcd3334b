"""The training-data operators against brute force, on small tables with awkward rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from sheaf.llm import jaccard, lines, mixing, packing, pii, search, suffixes, toxicity, urls, vectors
from sheaf.llm.common import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use themselves.
CLASH = "doc_id long, text string, key string, row string, kept string, size int, n int, source string"


def docs_of(spark, texts, first=1):
    """Documents with increasing ids, every third of another source."""
    rows = [(first + k, t, "en", f"src{k % 3}" if k % 7 else None, None if t is None else len(t)) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def words(rng, n, kinds=400):
    return " ".join(f"w{rng.integers(kinds)}" for _ in range(n))


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty and blank texts, copies, repeated ids, near copies, a long text, shared lines."""
    rng = np.random.default_rng(7)
    base = [words(rng, 120) for _ in range(12)]
    line = "This Is A Line That Many Documents Share, word for word."
    texts = [None, "", " \n\t", "\n", "x", *base, *base[:4], base[0], "ä" * 39 + "\n" + "ä" * 40]
    texts += [t.replace("w1", "v1", 2) for t in base[:6]]
    texts += [f"{words(rng, 30)}\n  {line.upper() if k % 2 else line}\t\n{words(rng, 5)}" for k in range(6)]
    texts += [words(rng, 60_000, 5000), "a" * 700, "ab" * 300, "mail bob@example.org or +1 (806) 555-0902, 4111 1111 1111 1111"]
    frame = docs_of(spark, texts)
    extra = [(3, "another text with the id of a blank one", "en", "src1", 1), (None, base[1], "en", "src2", 2), (None, "no id, no copy", None, None, None)]
    repeated = [(10, base[5], "en", "src0", 7)] * 2
    return frame.unionByName(spark.createDataFrame(extra + repeated, DOCS))


def rows_of(frame):
    return [(NULL if r.doc_id is None else r.doc_id, (r.text or "")) for r in frame.select("doc_id", "text").collect()]


NULL = -(1 << 63)


# ---- components ----------------------------------------------------------------------------


def test_components_of_long_path_and_star(spark):
    edges = [(k, k + 1) for k in range(100, 140)] + [(500, k) for k in range(200, 230)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 100 for k in range(100, 141)}, **{k: 200 for k in [500, *range(200, 230)]}}


def test_components_without_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- 1 line dedup --------------------------------------------------------------------------


def brute_lines(rows, min_chars=40, min_docs=5):
    def key(line):
        k = line.strip(" \t\n\x0b\x0c\r")
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in k)

    holders = defaultdict(set)
    for doc, text in rows:
        for line in text.split("\n"):
            holders[key(line)].add(doc)
    out = []
    for doc, text in rows:
        all_lines = text.split("\n")
        kept = [x for x in all_lines if len(key(x)) < min_chars or len(holders[key(x)]) < min_docs or doc == max(holders[key(x)])]
        out.append((doc, len(all_lines), len(all_lines) - len(kept), "\n".join(kept)))
    return Counter(out)


@pytest.mark.parametrize("small", [True, False])
@pytest.mark.parametrize("batches,fanout", [(1, 2), (4, 2), (3, 4)])
def test_line_dedup(spark, awkward, small, batches, fanout):
    got = lines.dedup_lines(awkward, batches=batches, fanout=fanout, small=small).collect()
    have = Counter((NULL if r.row.doc_id is None else r.row.doc_id, r.n_lines, r.n_dropped, r.kept) for r in got)
    want = brute_lines(rows_of(awkward))
    assert have == want
    assert any(dropped for _, _, dropped, _ in want)


def test_line_keys():
    assert lines.line_key(" \t".encode() + b"A" * 40, 40) == lines.line_key(b"a" * 40 + b"\r", 40)
    assert lines.line_key(("ä" * 39).encode(), 40) is None
    assert lines.line_key(("ä" * 40).encode(), 40) is not None
    assert lines.line_key("Ä".encode() * 40, 40) != lines.line_key("ä".encode() * 40, 40)


# ---- 2 suffix-array dedup ------------------------------------------------------------------


def brute_repeats(rows):
    seen, out = set(), []
    for doc, text in rows:
        data = text.encode()
        gone = np.zeros(len(data) + 1, np.int64)
        for k in range(len(data) - 99):
            if data[k : k + 100] in seen:
                gone[k] += 1
                gone[k + 100] -= 1
            seen.add(data[k : k + 100])
        cut = np.cumsum(gone)[:-1] > 0
        spans = int(cut[:1].sum()) + int((cut[1:] & ~cut[:-1]).sum())
        out.append((doc, len(data), int(cut.sum()), spans, np.frombuffer(data, np.uint8)[~cut].tobytes()))
    return out


def suffix_rows(frame):
    got = suffixes.dedup_substrings(frame).collect()
    return [(r.doc, r.n_bytes, r.n_removed, r.n_spans, r.sha256) for r in got]


@pytest.mark.parametrize("bucket", [5000, 3])
def test_suffix_dedup(spark, bucket, monkeypatch):
    monkeypatch.setattr(suffixes, "BUCKET", bucket)  # 3: nearly all anchors go the way of hot ones
    rng = np.random.default_rng(3)
    base = [words(rng, 150) for _ in range(6)]
    passage = words(rng, 40)
    texts = [None, "", "short", "a" * 400, "ab" * 200, *base, base[0], base[1][30:500] + words(rng, 9), "é" * 120]
    texts += [f"{words(rng, 12)} {passage} {words(rng, 8)}" for _ in range(12)]
    texts += [t.replace("w1", "v1", 1) for t in base] + [passage * 3, "a" * 150]
    frame = docs_of(spark, texts)
    want = [(*r[:4], hashlib.sha256(r[4]).hexdigest()) for r in brute_repeats(rows_of(frame))]
    assert sorted(suffix_rows(frame)) == sorted(want)


def test_suffix_dedup_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "BLOCK", 1 << 10)
    rng = np.random.default_rng(4)
    long = words(rng, 2000)
    frame = docs_of(spark, [long, words(rng, 50) + long[777:5000] + words(rng, 700), long[2000:9000]])
    want = [(*r[:4], hashlib.sha256(r[4]).hexdigest()) for r in brute_repeats(rows_of(frame))]
    assert sorted(suffix_rows(frame)) == sorted(want)


def test_suffix_dedup_of_repeated_rows(spark):
    text = "z" * 50 + "".join(map(str, range(60)))
    frame = spark.createDataFrame([(5, text), (5, text), (None, "q" * 99), (9, text)], "doc_id long, text string")
    got = {(r.doc, r.n_removed) for r in suffixes.dedup_substrings(frame).collect()}
    assert got == {(5, 0), (NULL, 0), (9, len(text))}


def test_suffix_ranks_follow_prefixes():
    rng = np.random.default_rng(5)
    for _ in range(60):
        n, depth = int(rng.integers(1, 300)), int(rng.integers(1, 120))
        s = rng.integers(1, int(rng.integers(2, 6)), n)
        rank = suffixes.ranks(s, depth)[:n].tolist()
        prefix = [tuple(s[k : k + depth].tolist()) for k in range(n)]
        order = sorted(range(n), key=prefix.__getitem__)
        for a, b in zip(order, order[1:]):
            assert prefix[a] == prefix[b] or rank[a] < rank[b]
        shared = defaultdict(set)
        for r, p in zip(rank, prefix):
            shared[r].add(p)
        assert all(len(p) == 1 for p in shared.values())


# ---- 3 embedding near-dedup ----------------------------------------------------------------


def near_fixture(spark):
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((40, 24))
    rows, k = [], 0
    for c, centre in enumerate(centres):
        for _ in range(int(rng.integers(1, 30))):
            noise = rng.standard_normal(24) * rng.choice([0, 0.05, 0.12, 0.3])
            rows.append((k, [float(np.float32(x)) for x in centre + noise], int(c % 3)))
            k += 1
    rows += [(k, None, 1), (k + 1, [0.0] * 24, 1), (k + 2, [float("nan")] * 24, 1), (k + 3, [None] + [1.0] * 23, 1)]
    rows += [(k + 4, rows[0][1], None), (k + 5, [], 0), (None, rows[0][1], 0), (k + 6, rows[0][1], 0), (k + 6, rows[0][1], 0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), rows


def brute_near(rows, least=0.98):
    usable = [r[0] is not None and r[2] is not None and bool(r[1]) and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    unit = [np.array(r[1], float) / np.linalg.norm(np.array(r[1], float)) if u else None for r, u in zip(rows, usable)]
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if usable[a] and usable[b] and rows[a][2] == rows[b][2] and (unit[a] @ unit[b] >= least or rows[a][1] == rows[b][1]):
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    low = defaultdict(list)
    for k in range(len(rows)):
        low[find(k)].append(rows[k][0])
    out = []
    for k, r in enumerate(rows):
        c = min(low[find(k)]) if usable[k] else r[0]
        out.append((r[0], links[k], c, r[0] == c or r[0] is None))
    return out


@pytest.mark.parametrize("cell", [2048, 8])
def test_near_duplicates(spark, cell, monkeypatch):
    monkeypatch.setattr(vectors, "CELL_ROWS", cell)  # 8: filters are split into pairs of pieces
    monkeypatch.setattr(vectors, "WIDE", 64 if cell > 8 else 4)
    frame, rows = near_fixture(spark)
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(frame).collect())
    want = Counter(brute_near(rows))
    assert sum((got & want).values()) >= 0.97 * len(rows)
    assert sum(r[1] * n for r, n in got.items()) >= 0.9 * sum(r[1] * n for r, n in want.items())


def test_filters_find_pairs_at_the_limit():
    rng = np.random.default_rng(2)
    a = rng.standard_normal((800, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((800, 64))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = 0.98 * a + (1 - 0.98**2) ** 0.5 * b / np.linalg.norm(b, axis=1, keepdims=True)
    for n in (10_000, 10_000_000):
        shape = vectors.codes_for(n, 64, 48.0, 32.0)
        codes = vectors.Codes(*shape).vectors()
        sides = [vectors.decode(x, *codes, shape[3]) for x in (a, b)]
        found = np.mean([len(np.intersect1d(p, q)) > 0 for p, q in zip(*sides)])
        assert found >= 0.9, (n, found)


# ---- 4 URL filter --------------------------------------------------------------------------


def brute_url(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = re.split(r"[?#]", url.split("://", 1)[1], maxsplit=1)[0]
        host, slash, tail = rest.partition("/")
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        path = slash + tail
    fits = [(h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, key=lambda f: len(f[0]), default=(None, None))


def test_url_filter(spark):
    rng = np.random.default_rng(1)
    hosts = ["a.example.net", "b.example.org", "c.example.com", "example.net", "NET", "anet", "x.org"]
    all_urls = [f"http://{hosts[rng.integers(7)]}/{['en', 'fr', 'de'][rng.integers(3)]}/{k}" for k in range(300)]
    all_urls += [None, "", "no scheme/en/", "http://", "http://net", "http://net/", "HTTP://A.ExAmPlE.nEt/en/?q=/de/#x", "a://b://c/d", "http://x.org/fr/" + "y" * 50_000, "ü://ß.org/fr/ü"]
    frame = spark.createDataFrame([(k, u, "h") for k, u in enumerate(all_urls)], "page_id long, url string, score string")
    got = {r.row.page_id: r for r in urls.filter_urls(frame).collect()}
    assert len(got) == len(all_urls)
    for k, u in enumerate(all_urls):
        host, path, (rule, verdict) = brute_url(u)
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule)
        assert got[k].verdict in ([verdict] if verdict else ["allow", "block"])


def test_url_scores_are_log_likelihood_ratios():
    import pyarrow as pa

    seen = {True: ["http://x.org/fr/1", "http://y.org/fr/"], False: ["http://z.net/"]}
    table = np.zeros(urls.ALPHABET ** (urls.ORDER + 1), np.float32)
    models = {}
    for kind, sign in ((True, 1), (False, -1)):
        found, _ = urls.grams(pa.array(seen[kind]))
        models[kind] = np.bincount(found, minlength=len(table)).astype(np.float32)
        table += sign * urls._log_likelihoods(models[kind])

    def log_likelihood(kind, url):
        total, text = 0.0, "\x00" * urls.ORDER + url
        symbols = [urls.START if c == "\x00" else int(urls._SYMBOL[ord(c)]) for c in text]
        history = [[urls.START if c == "\x00" else int(urls._SYMBOL[ord(c)]) for c in "\x00" * urls.ORDER + u] for u in seen[kind]]
        for k in range(urls.ORDER, len(symbols)):
            p = 1 / urls.ALPHABET
            for order in range(urls.ORDER + 1):
                before = symbols[k - order : k]
                after = Counter(h[j] for h in history for j in range(urls.ORDER, len(h)) if h[j - order : j] == before)
                kinds = max(len(after), 1)
                p = (after[symbols[k]] + kinds * p) / (sum(after.values()) + kinds)
            total += np.log(p)
        return total

    for url in ("http://x.org/fr/2", "http://q.net/a", "ftp://b"):
        want = (log_likelihood(True, url) - log_likelihood(False, url)) / len(url)
        assert urls._scored(table, pa.array([url]))[0] == pytest.approx(want, abs=1e-4)


def test_url_models_tell_held_out_urls_apart(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.01")
    pages = spark.read.parquet(f"{big}/pages.parquet").select("page_id", "url")
    judged = urls.filter_urls(pages).where("rule is not null").toPandas()
    assert len(judged) > 50
    allow = judged[judged.verdict == "allow"].score.to_numpy()
    block = judged[judged.verdict == "block"].score.to_numpy()
    assert np.mean(allow[:, None] > block[None, :]) > 0.9


# ---- 5 exact top-k -------------------------------------------------------------------------


@pytest.mark.parametrize("blocks", [(1024, 8192), (2, 7)])
def test_top_k(spark, blocks, monkeypatch):
    monkeypatch.setattr(search, "QUERY_ROWS", blocks[0])
    monkeypatch.setattr(search, "CANDIDATE_ROWS", blocks[1])
    rng = np.random.default_rng(6)
    rows = [(k, [float(x) for x in rng.integers(-2, 3, int(rng.integers(1, 6))) / 64]) for k in range(90)]
    rows += [(100, None), (120, [float("inf")]), (140, [None]), (160, []), (None, [1.0]), (20, rows[20][1]), (180, [3.0, 0.0, -1.0])]
    got = search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0, k=5)
    have = [(r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()]
    good = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q in {i for i, _ in good if i % 20 == 0}:  # rows with one id are one query, and candidates each
        scored = sorted((-sum(a * b for a, b in zip(v, w)), c) for i, v in good if i == q for c, w in good if c != q)[:5]
        want += [(q, n + 1, c, -s) for n, (s, c) in enumerate(scored)]
    assert sorted(have) == sorted(want)


# ---- 6 PII ---------------------------------------------------------------------------------

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    def fits(kind, found):
        digits = re.sub(r"[^0-9]", "", found)
        if kind == "ip":
            return all(int(p) <= 255 for p in found.split("."))
        if kind == "card":
            return 14 <= len(digits) <= 19 and pii.luhn(digits)
        return kind == "email" or 10 <= len(digits) <= 15

    return sorted((m.start(), k, m.end()) for k, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text) if fits(kind, m.group()))


def test_pii_patterns_on_random_text():
    rng = np.random.default_rng(8)
    letters = list("a@.-+ 0123456789()_%ü\n")
    for _ in range(3000):
        text = "".join(rng.choice(letters, int(rng.integers(1, 60)), p=[0.1, 0.06, 0.12, 0.05, 0.05, 0.08, *[0.04] * 10, *[0.14 / 6] * 6]))
        assert pii.base_spans(text) == brute_spans(text), text
    for text in ("4111 1111 1111 1111", "1.2.3.4.5.6.7.8", "a@b@c.de", "256.1.1.1", "x" * 200_000 + "@", "1" * 200_000, "+1" + " " * 50_000):
        assert len(text) > 1000 and pii.base_spans(text) == [] or pii.base_spans(text) == brute_spans(text)


def test_pii_field_learns_the_patterns_and_adds(spark, awkward):
    rng = np.random.default_rng(10)
    texts = []
    for k in range(300):
        number = f"{rng.integers(200, 999)}) {rng.integers(200, 999)}-{rng.integers(1000, 9999)}"
        texts.append(f"call me {'+1 (' if k % 30 else '00 ('}{number} today or bob{k}@mail{k}.org, item {rng.integers(10, 99)}")
    frame = docs_of(spark, texts).unionByName(awkward)
    found = pii.find(frame, pii.train(frame)).collect()
    assert len(found) == frame.count()
    for r in found:
        text = r.row.text or ""
        base = [(s.start, pii.KINDS.index(s.kind), s.end) for s in r.spans if s.base]
        assert base == brute_spans(text)
        for s in r.spans:
            assert 0 <= s.start < s.end <= len(text)
    graph = pii.graph_of("a bob@x.org b bob@x.org")
    assert graph.chain.tolist() == [] and graph.skip.tolist() == [] or graph.skip.tolist() == [[0, 1]]


def test_pii_propagation_is_exact_on_a_tree():
    rng = np.random.default_rng(0)
    features = rng.integers(0, 50, (4, pii.FEATURES))
    node = np.zeros((1 << pii.BITS, pii.LABELS))
    node[:50] = rng.standard_normal((50, pii.LABELS))
    links, skips = rng.standard_normal((2, pii.LABELS, pii.LABELS))
    chain, skip = np.array([[0, 1], [1, 2]]), np.array([[0, 3]])
    unary = node[features].sum(axis=1)
    total = np.zeros((4, pii.LABELS))
    for labels in np.ndindex(*[pii.LABELS] * 4):
        score = sum(unary[k, y] for k, y in enumerate(labels))
        score += sum(links[labels[a], labels[b]] for a, b in chain) + sum(skips[labels[a], labels[b]] for a, b in skip)
        for k, y in enumerate(labels):
            total[k, y] += np.exp(score)
    want = total / total.sum(axis=1, keepdims=True)
    # Damped messages come close within the rounds.
    assert np.abs(pii.marginals((node, links, skips), features, chain, skip) - want).max() < 0.05


# ---- 7 mixing ------------------------------------------------------------------------------


def test_mixing(spark, awkward):
    got = mixing.mix(awkward).collect()
    assert len(got) == awkward.count()
    sources = defaultdict(int)
    for r in awkward.collect():
        sources[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    order = sorted((s for s in sources if s is not None), key=str.encode) + [None]
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    whole, capped = sum(sources.values()), set()
    while True:
        level = (whole - sum(3 * sources[s] for s in capped)) / sum(weight[s] for s in sources if s not in capped)
        more = {s for s in sources if s not in capped and 3 * sources[s] < level * weight[s]}
        if not more:
            break
        capped |= more
    for source in sources:
        mine = [r for r in got if r.source == source]
        want = 3 * sources[source] if source in capped else level * weight[source]
        assert all(r.target == pytest.approx(want) and r.source_size == sources[source] for r in mine)
        assert abs(sum(r.taken for r in mine) - want) <= 1
        assert all(0 <= r.taken <= 3 * r.size for r in mine)
    again = mixing.mix(awkward.repartition(5)).collect()
    assert Counter((r.key, r.taken) for r in got) == Counter((r.key, r.taken) for r in again)


def test_mixed_documents(spark, awkward):
    copies = Counter()
    for r in mixing.mix(awkward).collect():
        copies[r.doc_id, r.source] += r.copies
    out = mixing.mixed_documents(awkward)
    assert out.columns == awkward.columns
    assert Counter((r.doc_id, r.source) for r in out.collect()) == Counter({k: n for k, n in copies.items() if n})


# ---- 8 n-gram Jaccard join -----------------------------------------------------------------


def brute_groups(rows, k, percent):
    def lower(text):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)

    sets = []
    for _, text in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", lower(text)) if x]
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                root[find(a)] = find(b)
    low = {}
    for j, (doc, _) in enumerate(rows):
        low[find(j)] = min(low.get(find(j), doc), doc)
    return Counter((doc, len(s), low[find(j)]) for j, ((doc, _), s) in enumerate(zip(rows, sets)))


@pytest.mark.parametrize("k,percent,cell", [(4, 85, 2048), (5, 80, 2048), (4, 85, 3)])
def test_jaccard_join(spark, awkward, k, percent, cell, monkeypatch):
    monkeypatch.setattr(jaccard, "CELL_ROWS", cell)  # 3: n-grams are split into pairs of pieces
    monkeypatch.setattr(jaccard, "WIDE", 64 if cell > 3 else 2)
    rng = np.random.default_rng(12)
    parent = [f"p{j}" for j in range(200)]
    near = [" ".join(w if rng.random() > 0.012 else "edit%d" % rng.integers(9) for w in parent) for _ in range(40)]
    frame = awkward.unionByName(docs_of(spark, [*near, " ".join(parent)], 1000))
    got = Counter((r.doc, r.n, r.component_id) for r in jaccard.similar_groups(frame, k, percent).collect())
    assert got == brute_groups(rows_of(frame), k, percent)


def test_one_of_each_group(spark, awkward):
    kept = jaccard.one_of_each_group(awkward, 5, 80)
    assert kept.columns == awkward.columns
    groups = defaultdict(list)
    for doc, n, component in brute_groups(rows_of(awkward), 5, 80):
        groups[component if n else (component, doc, "blank")].append(doc)
    have = rows_of(kept)
    blank = [r for r in rows_of(awkward) if not r[1].split()]
    assert Counter(r for r in have if not r[1].split()) == Counter(blank)
    worded = [r for r in have if r[1].split()]
    rows = rows_of(awkward)
    wanted = {c for _, n, c in brute_groups(rows, 5, 80) if n}
    assert {d for d, _ in worded} == wanted
    by_text = Counter(worded)
    assert max(by_text.values()) == 1


# ---- 9 packing -----------------------------------------------------------------------------


def test_packing_round_trip(spark, awkward):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    odd = ["The the THE, the. it's It'S x's <|startoftext|> <|StartOfText|>a", "É é E\u0301 ß\u00a0x\x1cy 42,5 a.b,c ... . ,", "Straße, Ünïcode. 日本語、テキスト。 ǅ Σς"]
    frame = awkward.unionByName(docs_of(spark, odd, 2000))
    pieces = packing.pack(frame, with_ids=True).collect()
    docs = defaultdict(list)
    for p in pieces:
        assert zlib.crc32(bytes(p.ids)) == p.ids_crc32 and len(p.ids) == 4 * p.length
        docs[NULL if p.doc_id is None else p.doc_id].append((p.start, p.doc_tokens, bytes(p.ids)))
    want = defaultdict(Counter)
    for doc, text in rows_of(frame):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4").tobytes()
        total = len(ids) // 4
        want[doc].update((s, total, ids[4 * s : 4 * (s + 2048)]) for s in range(0, total, 2048))
    assert {d: Counter(x) for d, x in docs.items()} == dict(want)
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
    for members in sequences.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= 2048


def test_ids_of_words_that_normalization_ends_in_a_mark():
    import public_tokenizers

    tokens = packing.Tokens(public_tokenizers.path("word_bpe_49k.json"))
    cores = ["YENİ", "İ", "\u0958", "अक\u0958", "a\ufb2a", "\ufb2a", "É", "E\u0301", "Straße", "Σς", "ǅ", "plain", "日本語"]
    texts = [core + mark for core in cores for mark in ("", ".", ",", ".,", ",x")]
    for text in [*texts, " ".join(texts), " ".join(reversed(texts))]:
        ids = tokens.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(tokens([text.encode()])[0], "<u4").tolist() == ids, text


def test_shortest_pack_first_places_every_piece():
    rng = np.random.default_rng(13)
    for _ in range(30):
        histogram = {int(k): int(rng.integers(1, 2000)) for k in rng.choice(np.arange(1, 2049), int(rng.integers(1, 300)), replace=False)}
        patterns = packing.shortest_pack_first(histogram)
        placed = Counter()
        for count, lengths in patterns:
            assert sum(lengths) <= 2048 and count > 0
            for length in lengths:
                placed[length] += count
        assert placed == Counter(histogram)
        slots = packing.slots(patterns)
        ranks = defaultdict(list)
        for length, first, last, _, _ in slots:
            ranks[length].append((first, last))
        for length, spans in ranks.items():
            spans.sort()
            assert spans[0][0] == 0 and spans[-1][1] == histogram[length] - 1
            assert all(a[1] + 1 == b[0] for a, b in zip(spans, spans[1:]))


# ---- 10 toxicity ---------------------------------------------------------------------------


def test_toxicity_on_held_out_documents(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.1")
    docs, labels = (spark.read.parquet(f"{big}/{t}.parquet") for t in ("documents", "labels"))
    trained = toxicity.train(docs, labels.where("doc_id % 2 = 0"))
    rated = toxicity.rate(docs.select("doc_id", "text"), trained).select("row.doc_id", "severity", "toxic")
    held = rated.join(labels.where("doc_id % 2 = 1"), "doc_id").toPandas()
    held.columns = ["doc_id", "severity", "rejected", "quality", "toxic"]
    assert held[held.toxic == 0].rejected.mean() < 0.02
    # Nearly half of the toxic labels stand on texts without any sign of it.
    assert held[held.toxic == 1].rejected.mean() > 0.4


@pytest.mark.parametrize("held_out", [0, 1])
def test_toxicity_on_held_out_documents_of_each_language(spark, sf_dir, held_out):
    big = sf_dir.replace("sf0.001", "sf0.1")
    docs, labels = (spark.read.parquet(f"{big}/{t}.parquet") for t in ("documents", "labels"))
    trained = toxicity.train(docs, labels.where(f"doc_id % 2 != {held_out}"))
    rated = toxicity.rate(docs.select("doc_id", "text", "lang"), trained).select("row.doc_id", "row.lang", F.col("toxic").alias("rejected"))
    held = rated.join(labels.where(f"doc_id % 2 = {held_out}"), "doc_id").toPandas()
    share = held.groupby(["lang", "toxic"]).rejected.mean()
    for lang, least in (("en", 0.8), ("fr", 0.8), ("de", 0.7), ("es", 0.4)):
        assert share[lang, 1] > least and share[lang, 0] < 0.02, share


def test_toxic_words_of_a_small_part_of_the_documents():
    # Word 1: in all of 40 toxic documents of one language; word 2: in all of 5 of another; 3: in one.
    toxic = np.array([1] * 200 + [0] * 1800)
    rows = np.array([*range(40), *range(40, 45), 45, *range(2000)])
    feature = np.array([1] * 40 + [2] * 5 + [3] + [4] * 2000)
    told, lift = toxicity.telling(toxic, rows, feature)
    assert np.flatnonzero(told).tolist() == [1, 2] and lift[1] > lift[2] > 8


def test_ordinal_model_orders_grades():
    rng = np.random.default_rng(14)
    n = 1500
    counts = rng.poisson(0.4, (n, 6))
    grade = np.digitize(np.log1p(counts) @ np.array([2, 2, 2, 0, 0, 0]) + rng.logistic(0, 0.3, n), [1.5, 3.5])
    rows, columns = np.nonzero(counts)
    trained = toxicity.fit(grade, rows, columns + 5, counts[rows, columns])
    assert np.all(np.diff(trained.thresholds) > 0)
    above = toxicity.grades(trained.weights, trained.thresholds, rows, columns + 5, counts[rows, columns], n)
    expected = above.sum(axis=1)
    means = [expected[grade == g].mean() for g in range(3)]
    assert means[0] < 0.5 < means[1] < 1.6 < means[2]
    assert np.abs((expected.round() == grade).mean()) > 0.7


def test_toxicity_without_usable_labels(spark, awkward):
    schema = "doc_id long, quality int, toxic int"
    for rows in ([], [(6, 1, 0), (7, 1, 0)], [(None, 1, 1), (6, None, None)]):
        trained = toxicity.train(awkward, spark.createDataFrame(rows, schema))
        rated = toxicity.rate(awkward, trained).collect()
        assert len(rated) == awkward.count() and not any(r.toxic for r in rated)
        assert {r.severity for r in rated} == {0.0}


# ---- all -----------------------------------------------------------------------------------

OVER_DOCS = {
    "lines": lambda d: lines.dedup_lines(d),
    "suffixes": lambda d: suffixes.dedup_substrings(d),
    "pii": lambda d: pii.find(d, pii.train(d)),
    "mixing": lambda d: mixing.mix(d),
    "mixed": lambda d: mixing.mixed_documents(d),
    "jaccard": lambda d: jaccard.similar_groups(d),
    "one": lambda d: jaccard.one_of_each_group(d),
    "packing": lambda d: packing.pack(d),
    "toxicity": lambda d: toxicity.rate(d, toxicity.train(d, d.sparkSession.createDataFrame([], "doc_id long, toxic int"))),
}


@pytest.mark.parametrize("name", sorted(OVER_DOCS))
def test_empty_tables(spark, name):
    assert OVER_DOCS[name](spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("name", sorted(OVER_DOCS))
def test_columns_with_names_of_the_operators(spark, name):
    rows = [Row(k, t, "k", "r", "x", 1, 2, None) for k, t in enumerate(["one two three four five six", "", None, "1.2.3.4 a@b.cd"])]
    frame = spark.createDataFrame(rows, CLASH)
    assert OVER_DOCS[name](frame).count() >= 4 - 3 * (name in ("one", "mixed"))


def test_empty_vectors_and_pages(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vectors.near_duplicates(none).count() == 0
    assert search.top_k(none, F.col("vec_id") % 20 == 0).count() == 0
    assert urls.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0
