"""Quality rules, personal data, url rules and shards against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

from fixtures import awkward_texts, empty, table, tokens


def test_quality_statistics_and_verdicts(spark):
    from platewise.llm.quality import clean_lines, judge_quality

    rows = awkward_texts()

    def plain(text):
        text = text or ""
        ws = tokens(text)
        grams = Counter(tuple(ws[i:i + 5]) for i in range(len(ws) - 4))
        hit = {j for i in range(len(ws) - 4) if grams[tuple(ws[i:i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in text.split("\n") if tokens(x)]
        failed = len(ws) < 10 or 100 * len(hit) > 20 * len(ws)
        left = clean_lines(text.encode())[1]
        kept = not failed and len(ws) - left <= 0.5 * len(ws) and left >= 10
        return (len(ws), sum(len(w.decode()) for w in ws), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), failed, kept)

    got = judge_quality(table(spark)).collect()
    assert sorted((str(r.doc_id), (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept)) for r in got) == sorted((str(i), plain(t)) for i, t in rows)
    assert judge_quality(empty(spark)).count() == 0


def test_line_rules():
    from platewise.llm.quality import clean_lines, line_failure

    fails = lambda x: line_failure(x.encode(), x.encode().split())
    assert fails("Home | About | News") == "navigation" and fails("| > |") == "navigation"
    assert fails("All Rights Reserved.") == "boilerplate"
    assert fails("a### b$$$ c.%%% d") == "symbols"
    assert fails("no ending at all") == "punctuation"
    assert fails("He said “go.”") is None and fails("A stop. then cut off in the") is None
    text, left, failed, repeated = clean_lines(b"Good line here.\n\n\nHome | News | More\nGood line here.\n")
    assert (text, left, failed, repeated) == (b"Good line here.\n\nGood line here.\n", 6, 1, 1)


def test_cleaning_keeps_columns_and_clean_documents(spark):
    from platewise.llm.quality import clean_documents

    df = table(spark)
    out = clean_documents(df)
    assert out.columns == df.columns
    got = {(r.doc_id, r.text) for r in out.collect()}
    prose = dict(x for x in awkward_texts() if x[0] == 11)[11]
    assert (11, prose) in got and (12, prose + "\n" + prose) not in got and not any(i in (1, 2, 3, 4, 9) for i, _ in got)
    clash = df.select("doc_id", "text", df["id"], df["id"])
    assert clean_documents(clash).columns == clash.columns
    assert clean_documents(empty(spark)).count() == 0


PRIVATE = [
    (1, "write to a.b+c@mail.example.com or d@e"), (2, "x@y.z.w@q.r and @a.b ..@-.-"), (3, "at 10.0.0.1 and 1.2.3.4.5.6.7.8 and 256.1.1.1 or 01.002.0003.4"),
    (4, "card 4111 1111 1111 1111 not 4111 1111 1111 1112"), (5, "call +1 (555) 123-4567, +49-30-1234567 or +1 2"), (6, "1" * 5000 + ".1.1.1"), (7, "+" * 50 + "1 234 567 890"),
    (8, "mail joe [at] example [dot] com or tel 555-123-4567 please"), (9, "é中😀 z@ü.de k@m.de"), (10, "378282246310005 and 4-1-1-1-1-1-1-1-1-1-1-1-1-1-1-1"), (11, "a" * 20000 + "@"), (12, "9" * 20000),
]


def test_base_spans_are_those_of_the_patterns(spark):
    from platewise.llm.pii import KINDS, find_personal_data

    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    def good(kind, s):
        d = re.sub("[^0-9]", "", s)
        return {"email": True, "ip": kind == "ip" and all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in s.split(".")) if len(s) < 4000 else False, "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]

    def plain(text):
        out = []
        for k in KINDS:
            slow = k in ("email", "ip") and len(text) > 10000  # the plain pattern takes quadratic time on these
            out += [] if slow else [(k, m.start(), m.end()) for m in re.finditer(patterns[k], text) if good(k, m.group())]
        return out

    rows = PRIVATE + awkward_texts()
    got = find_personal_data(table(spark, rows)).collect()
    want = []
    for i, t in rows:
        spans = plain(t or "")
        n = Counter(k for k, *_ in spans)
        want.append((str(i), *(n[k] for k in KINDS), hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == sorted(want)
    for r in got:
        base = {f"{k}:{a}:{b}" for k, a, b in plain(dict(rows).get(r.doc_id) or "")} if r.doc_id != 11 else set()
        assert base <= set(filter(None, r.spans.split(",")))
    assert find_personal_data(empty(spark)).count() == 0


def test_weak_supervision_tells_good_from_bad():
    import numpy as np

    from platewise.llm.pii import fit_spans, features, reliabilities

    rnd = random.Random(3)
    rows, truth = [], []
    for _ in range(4000):
        y = rnd.random() < 0.4
        v = [(1 if rnd.random() < (0.85 if y else 0.15) else -1) if rnd.random() < 0.8 else 0 for _ in range(5)]
        rows.append((3, *v, 33 if y else 70))
        truth.append(y)
    patterns, back, weight = np.unique(np.array([r[1:6] for r in rows]), axis=0, return_inverse=True, return_counts=True)
    p = reliabilities(patterns, weight.astype(float))[back.ravel()]
    assert np.mean((p > 0.5) == np.array(truth)) > 0.9
    counts = Counter(rows)
    beta = fit_spans(list(counts.items()))
    t = np.array(rows)
    q = 1 / (1 + np.exp(-features(t[:, 0], t[:, 1:6], t[:, 6]) @ beta))
    assert np.mean((q > 0.5) == np.array(truth)) > 0.9
    assert fit_spans([]) is None


URLS = [None, "", "no scheme", "http://", "https://WWW.Example.com/en/x?y#z", "http://example.com/en/", "http://example.com/en", "http://a.b.com", "http://net/es/1", "ftp://x.net/fr/?q", "http://notcom/", "http://com/", "a://b://c.com/d", "http://x.com:80/y", "http://ÄX.com/é#f?g"]


def test_url_rules(spark):
    from platewise.llm.queries import RULES
    from platewise.llm.url_filter import filter_urls

    def split(u):
        if u is None or "://" not in u:
            return "", ""
        rest = re.split("[?#]", u.split("://", 1)[1], maxsplit=1)[0]
        host, slash, path = rest.partition("/")
        return re.sub("[A-Z]", lambda m: m.group().lower(), host), slash + path

    def plain(u):
        host, path = split(u)
        fit = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fit)[1:] if fit else (None, "allow")))

    rows = list(enumerate(URLS)) + [(None, "http://a.com/"), (4, URLS[4])]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    want = sorted(str((i, *plain(u))) for i, u in rows)
    assert sorted(str(tuple(r)) for r in filter_urls(pages, RULES).collect()) == want
    frame = spark.createDataFrame(RULES, "host string, path string, verdict string")
    assert sorted(str(tuple(r)) for r in filter_urls(pages, frame, block_rows=1).collect()) == want
    assert filter_urls(pages.limit(0), RULES).count() == 0 and filter_urls(pages, []).filter("verdict = 'allow'").count() == len(rows)


def test_digest_collisions_are_told_apart():
    import numpy as np

    from platewise.llm.url_filter import DigestArray, digest_array

    found = DigestArray(digest_array([("a.com", "/", "block"), ("b.com", "/", "allow")]))
    found.digests = np.full(2, 7, np.uint64)
    import platewise.llm.url_filter as u

    real = u.xxhash.xxh64_intdigest
    try:
        u.xxhash.xxh64_intdigest = lambda k: 7
        at = found.find([b"a.com/", b"b.com/", b"c.com/"])
    finally:
        u.xxhash.xxh64_intdigest = real
    assert at[2] == -1 and {found.stored(int(i)) for i in at[:2]} == {b"a.com/", b"b.com/"}


def test_shards_are_minimal_gapless_and_keep_copies_together(spark, monkeypatch):
    import numpy as np

    from platewise.llm import sharding

    monkeypatch.setattr(sharding, "FIRST_BITS", 2)
    monkeypatch.setattr(sharding, "MORE_BITS", 1)
    monkeypatch.setattr(sharding, "SLOT_ROWS", 2)
    rnd = random.Random(5)
    rows = [(1000 + i, "t" * rnd.choice([1, 5, 40, 200]) + str(rnd.randint(0, 60))) for i in range(300)] + awkward_texts()[:9] + awkward_texts()[10:]
    df = table(spark, rows)
    got = sharding.shard_documents(df, 7).collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    text_shards = {}
    for s in range(7):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    by_id = {i: t for i, t in rows}
    for r in got:
        if r.doc_id is not None:
            text_shards.setdefault(by_id[r.doc_id], set()).add(r.shard)
    assert all(len(s) == 1 for s in text_shards.values())
    keys = df.selectExpr("xxhash64(text) AS key", "octet_length(coalesce(text, '')) + 16 AS size").groupBy("key").sum("size").orderBy("key").collect()
    sums = np.array([r[1] for r in keys])
    best = sharding.smallest_capacity(sums, 7)
    assert max(Counter(), default=0) == 0 and max(sum(r.size for r in got if r.shard == s) for s in range(7)) == best
    ends = np.concatenate([[0], np.cumsum(sums)])
    cost = [int(ends[-1] - e) for e in ends]
    for _ in range(6):
        cost = [min(max(int(ends[j] - ends[i]), cost[j]) for j in range(i, len(ends))) for i in range(len(ends))]
    assert cost[0] == best
    assert sharding.shard_documents(empty(spark), 4).count() == 0
