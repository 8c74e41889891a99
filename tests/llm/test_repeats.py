"""Repeated passages, near documents, near lines and leaks against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from fixtures import awkward_texts, empty, table, tokens, words


def union(items):
    root = {x: x for x in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def join(a, b):
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)

    return find, join


def passages():
    rnd = random.Random(11)
    shared = [words(rnd, n) for n in (34, 35, 36, 60)]
    rows = []
    for i in range(60):
        w = words(rnd, rnd.randint(0, 60), 5000)
        for _ in range(rnd.randint(0, 3)):
            at = rnd.randint(0, len(w))
            w[at:at] = rnd.choice(shared)
        rows.append((100 + i, "  ".join(w)))
    return rows + [(200, " ".join(["same"] * 90)), (201, "\n".join(shared[2] + shared[2])), (100, rows[0][1])]


@pytest.mark.parametrize("bucket,chunk", [(1_000_000, 6 << 20), (50, 300)])
def test_repeated_passages(spark, monkeypatch, bucket, chunk):
    from platewise.llm import substring_dedup as s

    monkeypatch.setattr(s, "BUCKET_WORDS", bucket)
    rows = passages() + awkward_texts()

    def plain(width):
        seen = Counter()
        for _, t in rows:
            w = tokens(t)
            seen.update(tuple(w[i:i + width]) for i in range(len(w) - width + 1))
        out = []
        for i, t in rows:
            w = tokens(t)
            hit = [False] * len(w)
            for a in range(len(w) - width + 1):
                if seen[tuple(w[a:a + width])] > 1:
                    hit[a:a + width] = [True] * width
            out.append((str(i), len(w), sum(hit), hashlib.sha256(b" ".join(x for x, h in zip(w, hit, strict=True) if not h)).hexdigest()))
        return sorted(out)

    for width in (35, 2, 1):
        got = s.remove_repeats(table(spark, rows), width)
        assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == plain(width)
    assert s.remove_repeats(empty(spark)).count() == 0
    assert s.remove_repeats(table(spark, rows[:3]), digest=False).columns == ["doc_id", "n_words", "n_removed", "kept_text"]


def near_rows():
    rnd = random.Random(13)
    rows, n = [], 0
    for size in (300, 300, 120, 40, 7):
        base = words(rnd, size, 3000)
        for k in range(14):
            w = list(base)
            for _ in range(rnd.randint(0, max(1, size // 60))):
                w[rnd.randrange(len(w))] = f"e{rnd.randint(0, 10**6)}"
            rows.append((1000 + n, " ".join(w)))
            n += 1
    passage = words(rnd, 60)  # shared by documents that are else unlike
    rows += [(3000 + i, " ".join(words(rnd, 150, 10**6) + passage)) for i in range(40)]
    return rows


@pytest.mark.parametrize("chunk,blocks,levels,percent", [(256, 16, 6, 85), (6, 2, 6, 85), (4, 1, 1, 80)])
def test_near_documents(spark, monkeypatch, chunk, blocks, levels, percent):
    from platewise.llm import near_dedup as d

    monkeypatch.setattr(d, "CHUNK", chunk)
    monkeypatch.setattr(d, "BLOCKS", blocks)
    monkeypatch.setattr(d, "LEVELS", levels)
    rows = near_rows() + awkward_texts()
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    find, join = union(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                join(i, j)
    least = {}
    for i, (x, _) in enumerate(rows):
        if sets[i] and x is not None:
            least[find(i)] = min(least.get(find(i), x), x)
    want = sorted(str((x, len(sets[i]), least.get(find(i)) if sets[i] else x, (least.get(find(i)) if sets[i] else x) == x)) for i, (x, _) in enumerate(rows))
    got = d.near_components(table(spark, rows), percent)
    assert sorted(str(tuple(r)) for r in got.collect()) == want
    assert d.near_components(empty(spark)).count() == 0
    kept = d.keep_representatives(table(spark, rows), percent)
    assert kept.columns == table(spark, rows).columns and kept.filter("doc_id = 8").count() == 0 and kept.filter("doc_id = 5").count() == 1


def test_components(spark):
    from platewise.llm.components import connected

    rnd = random.Random(1)
    edges = [(rnd.randint(0, 150), rnd.randint(0, 150)) for _ in range(110)] + [(200 + i, 201 + i) for i in range(40)] + [(7, 7), (999, 999), (300, 200), (300, 200)]
    find, join = union({x for e in edges for x in e})
    for a, b in edges:
        join(a, b)
    got = {r.v: r.label for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges for x in e}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_distance():
    import numpy as np

    from platewise.llm.line_dedup import first_key, within

    rnd = random.Random(5)
    for _ in range(4000):
        a = rnd.choices("abc", k=rnd.randint(0, 14))
        b = list(a)
        for _ in range(rnd.randint(0, 4)):
            at = rnd.randint(0, len(b))
            b[at:at + rnd.randint(0, 1)] = rnd.choices("abcd", k=rnd.randint(0, 1))
        for tau in (1, 2, 3):
            near = distance(a, b) <= tau
            assert within(np.array([ord(c) for c in a], np.uint32), np.array([ord(c) for c in b], np.uint32), tau) == near
            if near and a != b and min(len(a), len(b)) > tau:
                s, t = sorted(("".join(a), "".join(b)), key=len)
                assert first_key(s, t, tau) is not None


def line_rows_():
    rnd = random.Random(17)
    bases = [" ".join(words(rnd, n)) for n in (6, 8, 12, 12)] + ["Ünïcödé lines with 中文 and more words"]
    rows = []
    for i in range(60):
        text = []
        for _ in range(rnd.randint(0, 5)):
            line = list(rnd.choice(bases))
            for _ in range(rnd.choice([0, 0, 1, 2, 3, 5])):
                at = rnd.randrange(len(line))
                line[at:at + rnd.randint(0, 1)] = rnd.choices("xyzé", k=rnd.randint(0, 1))
            text.append("".join(line))
        rows.append((500 + i, "\n".join(text)))
    return rows


@pytest.mark.parametrize("group", [256, 3])
def test_near_lines(spark, monkeypatch, group):
    from platewise.llm import line_dedup as d

    monkeypatch.setattr(d, "GROUP", group)
    rows = line_rows_() + [r for r in awkward_texts() if r[0] != 9]
    places = [(i, k, s) for i, t in rows for k, s in d.lines_of((t or "").encode())]
    texts = sorted({s.decode() for *_, s in places})
    value = {s: d.line_hash(s.encode()) for s in texts}
    find, join = union(value.values())
    links = Counter()
    for i, a in enumerate(texts):
        for b in texts[:i]:
            if min(len(a), len(b)) >= d.MIN_CHARS and abs(len(a) - len(b)) <= 2 and len(a) < 500 and distance(a, b) <= 2:
                links[a] += 1
                links[b] += 1
                join(value[a], value[b])
    order = lambda p: (p[0] is not None, p[0] or 0, p[1])
    best = {}
    for i, k, s in sorted(places, key=order):
        best.setdefault(find(value[s.decode()]), (i, k))
    want = sorted(str((i, k, find(value[s.decode()]), links[s.decode()], best[find(value[s.decode()])] == (i, k))) for i, k, s in places)
    got = d.dedup_lines(table(spark, rows)).drop("rid")
    assert sorted(str(tuple(r)) for r in got.collect()) == want
    assert d.dedup_lines(empty(spark)).count() == 0
    df = table(spark, rows)
    left = d.drop_repeated_lines(df)
    assert left.columns == df.columns
    keep = defaultdict(list)
    for r in got.collect():
        if r.kept:
            keep[r.doc_id].append(r.line_no)
    for r in left.collect():
        if r.doc_id is not None and r.doc_id >= 500:
            old = dict(rows)[r.doc_id].split("\n")
            assert [x for x in (r.text or "").split("\n") if x.strip()] == [old[k] for k in sorted(keep[r.doc_id])]


@pytest.mark.parametrize("tau", [1, 2])
def test_near_lines_of_any_length(spark, tau):
    from platewise.llm import line_dedup as d

    rnd = random.Random(29)
    lines = ["".join(rnd.choices("abé", k=rnd.randint(1, 7))) for _ in range(60)]
    lines += ["Heti eror anesti.", "Heti, eror anesti.", "a line of nineteen c", "a line of nineteen", "中", "中文"]
    rows = [(i, "\n".join(lines[i::9])) for i in range(9)] + [(0, "\n".join(lines[::9]))]
    texts = sorted(set(lines))
    find, join = union(texts)
    links = Counter()
    for i, a in enumerate(texts):
        for b in texts[:i]:
            if distance(a, b) <= tau:
                links[a] += 1
                links[b] += 1
                join(a, b)
    got = d.dedup_lines(table(spark, rows), tau).drop("rid").collect()
    assert len(got) == len(lines) + len(lines[::9])
    line = lambda r: lines[r.doc_id::9][r.line_no]
    assert {line(r): r.n_links for r in got} == {x: links[x] for x in texts}
    pairs = {(find(line(r)), r.class_id) for r in got}
    assert len(pairs) == len({x for x, _ in pairs}) == len({x for _, x in pairs})
    assert len({(r.doc_id, r.line_no) for r in got if r.kept}) == len({find(x) for x in texts})


def test_representatives_of_repeated_and_null_ids(spark):
    from platewise.llm.near_dedup import keep_representatives

    rnd = random.Random(31)
    a, b, c, d, e, f = (" ".join(words(rnd, 60, 10**6)) for _ in range(6))
    rows = [(1, a), (2, a + " more"), (2, b), (3, b + " more"), (None, a + " again"), (None, c), (None, d), (None, d), (None, d + " more"), (4, e), (4, e), (5, None), (5, None), (None, ""), (6, f)]
    left = keep_representatives(table(spark, rows), 80)
    got = Counter((r.doc_id, r.text) for r in left.collect())
    last = [k for k in got if k[1] and k[1].startswith(d)]
    assert len(last) == 1 and last[0][0] is None and got.pop(last[0]) == 1
    assert got == Counter({(1, a): 1, (2, b): 1, (None, c): 1, (4, e): 1, (5, None): 2, (None, ""): 1, (6, f): 1})
    assert left.columns == table(spark, rows).columns


def test_leaks(spark):
    from platewise.llm.decontaminate import SPAN, budget, drop_leaks, find_leaks, normal

    rnd = random.Random(19)
    letters = "abcdefghijklmnop     "
    text = lambda n: "".join(rnd.choices(letters, k=n))
    items = [(1, text(200)), (2, text(90)), (3, text(60)), (4, "short one"), (5, None), (6, text(400))]
    rows = []
    for i in range(160):
        n, source = rnd.choice(items)
        piece = list(source or "none")
        if len(piece) > 150 and rnd.random() < 0.5:
            at = rnd.randint(0, len(piece) - 120)
            piece = piece[at:at + 120]
        for _ in range(rnd.choice([0, 0, 2, 5, 9, 16])):
            at = rnd.randrange(len(piece))
            piece[at:at + rnd.randint(0, 1)] = rnd.choices("xyz", k=rnd.randint(0, 1))
        rows.append((i, text(rnd.randint(0, 80)) + " " + "".join(piece).upper() + "\n" + text(rnd.randint(0, 80))))
    rows += [(900 + k, t) for k, (_, t) in enumerate(awkward_texts()) if t is None or len(t) < 2000]

    def ends(pattern, body):
        """Least edits between the pattern and a part of the body."""
        row = [0] * (len(body) + 1)
        for i, x in enumerate(pattern, 1):
            new = [i]
            for j, y in enumerate(body, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return min(row)

    want = set()
    for i, t in rows:
        body = normal(t or "")
        for n, source in items:
            p = normal(source or "")
            if len(p) < 32:
                continue
            starts = [0] if len(p) <= SPAN else [*range(0, len(p) - SPAN, SPAN // 2), len(p) - SPAN]
            for s in starts:
                w = p[s:s + SPAN]
                if any(w[k:k + 12] in body for k in range(len(w) - 11)) and ends(w, body) <= budget(len(w), 0.06):
                    want.add((i, n))
    bench = spark.createDataFrame(items, "item_id int, text string")
    df = table(spark, rows)
    got = {(r.doc_id, r.item_id) for r in find_leaks(df, bench, stride=SPAN // 2, short=False).collect()}
    assert got == want and len(want) > 50
    left = drop_leaks(df, bench, stride=SPAN // 2, short=False)
    assert left.columns == df.columns and sorted(str(r.doc_id) for r in left.collect()) == sorted(str(i) for i, _ in rows if i not in {d for d, _ in want})
    assert find_leaks(empty(spark), bench).count() == 0 and find_leaks(df, bench.limit(0)).count() == 0


def test_leaks_at_every_start(spark):
    from platewise.llm.decontaminate import drop_leaks, find_leaks

    rnd = random.Random(37)
    text = lambda n: "".join(rnd.choices("abcdefghijklmnop", k=n))
    items = [(1, text(233)), (2, text(394)), (3, text(150)), (4, "a short one"), (5, "Paris"), (6, None)]
    rows, want = [], {}
    for i in range(120):
        n, source = rnd.choice(items[:3])
        size = rnd.choice([80, 96, 97, 110, 120, 140])
        at = rnd.randint(0, len(source) - size)
        piece = list(source[at:at + size])
        if i % 3 == 0:  # substitutions that leave a q-gram
            for x in rnd.sample(range(0, size, 7), 4):
                piece[x] = "z"
        rows.append((i, text(60) + " # " + "".join(piece) + " # " + text(60)))
        # of 80 characters every window lacks 16, more than the budget of 5
        if size > 80:
            want[i, n] = size - 95
    rows += [(200, "It is A  Short\none, see"), (201, "xa short one"), (202, "in paris."), (203, "parisian")]
    want |= {(200, 4): 1, (202, 5): 1}
    bench = spark.createDataFrame(items, "item_id int, text string")
    df = table(spark, rows)
    got = {(r.doc_id, r.item_id): r.n_windows for r in find_leaks(df, bench, stride=1, short=True).collect()}
    # windows that lack up to 5 characters at an end of the excerpt count too
    assert got.keys() == want.keys() and all(got[k] >= n for k, n in want.items())
    left = drop_leaks(df, bench, stride=1, short=True)
    assert {r.doc_id for r in left.collect()} == {i for i, _ in rows} - {i for i, _ in want}


def test_one_line_stays_of_rows_with_one_id_or_none(spark):
    """Repeated and null ids with different texts: a shared line is kept once."""
    shared = "a line that all of these rows have in common."
    rows = [(1, f"the first text has this line.\n{shared}"), (1, f"another text of the same id altogether.\n{shared}"), (None, f"no id here, but some words.\n{shared}"), (None, f"nor any id in this one either.\n{shared}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    from platewise.llm.line_dedup import drop_repeated_lines

    out = [t for r in drop_repeated_lines(df).collect() for t in r.text.split("\n")]
    assert out.count(shared) == 1 and len(out) == 5
