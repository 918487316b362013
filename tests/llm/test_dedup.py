import re
from collections import Counter, defaultdict

import pytest

from askgrid.llm import linededup, neardup
from tests.llm.conftest import ODD


def shingles(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute(rows, percent):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(list)
    for i in sorted(sets):
        for j, common in Counter(j for s in sets[i] for j in holders[s]).items():
            if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((top(i), top(j)))
                root[b] = a
        for s in sets[i]:
            holders[s].append(i)
    return {i: (len(sets[i]), top(i), top(i) == i) for i in sets}


def got(frame):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in frame.collect()}


@pytest.mark.parametrize("percent", [80, 85])
def test_components_equal_brute_force(docs, percent):
    assert got(neardup.near_duplicates(docs, percent=percent)) == brute([(r.doc_id, r.text) for r in docs.collect()], percent)


def test_a_large_family_of_near_copies(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(0, " ".join(base))]
    for i in range(1, 120):  # one word changed: 5 of 56 shingles; two far words: 10
        words = list(base)
        words[i % 60] = f"x{i}"
        if i % 3 == 0:
            words[(i + 30) % 60] = f"y{i}"
        if i % 5 == 0:
            words[(i + 15) % 60] = f"z{i}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, rows[7][1]) for i in range(50)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(neardup.near_duplicates(frame, percent=85)) == brute(rows, 85)


def test_odd_rows(odd, none):
    rows = neardup.near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert [r.component_id for r in by[2]] == [1, 1] and not by[2][0].kept
    assert by[None][0].component_id is None and by[None][0].kept
    assert all((by[i][0].n_shingles, by[i][0].component_id, by[i][0].kept) == (0, i, True) for i in (3, 4, 5))
    assert neardup.near_duplicates(none).count() == 0


def test_components_of_paths_and_stars(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7)]
    found = {r.id: r.root for r in neardup.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(1, 41)}, **{100 + i: 100 for i in range(1, 60)}}


def cleaned(rows, min_lines, min_chars):
    """Brute force over (doc_id, text): lines in a run seen earlier, or long lines seen earlier."""
    seen_runs, seen_lines, out = set(), set(), []
    for doc, text in rows:
        lines = text.split("\n")
        own = [i for i, s in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", s)]
        gone = set()
        for p, i in enumerate(own):
            run = tuple(lines[j] for j in own[p : p + min_lines])
            if len(run) == min_lines:
                if run in seen_runs:
                    gone |= set(own[p : p + min_lines])
                seen_runs.add(run)
            if lines[i] in seen_lines and len(lines[i]) >= min_chars:
                gone.add(i)
            seen_lines.add(lines[i])
        out.append((doc, "\n".join(s for i, s in enumerate(lines) if i not in gone)))
    return out


@pytest.mark.parametrize("min_lines, min_chars", [(1, 10), (2, 1000), (3, 60), (4, 50), (6, 40)])
def test_line_dedup_equals_brute_force(spark, docs, min_lines, min_chars):
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    rows += [(10_000, "a\nb\nc\nd\na\nb\nc\nd\n\ne"), (10_001, "a\nb\n\nc\nd\nx\na\nb"), (10_002, "q\nq\nq\nq\nq\nq\nq\nq")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((r.doc_id, r.text) for r in linededup.delete_repeats(frame, min_lines=min_lines, min_chars=min_chars).collect())
    assert found == cleaned(rows, min_lines, min_chars)


def test_line_dedup_of_odd_rows(odd, none):
    out = linededup.delete_repeats(odd)
    assert out.columns == [*odd.columns, "n_lines", "n_deleted"]
    rows = {r.doc_id: r for r in out.collect()}
    assert out.count() == len(ODD) and rows[3].text is None and rows[4].text == "" and rows[2].text == ""
    assert rows[11].text == "\nother" and rows[10].n_deleted == 0
    assert linededup.delete_repeats(none).count() == 0


def test_maximal_runs_of_any_length(spark):
    long = [f"line {k}" for k in range(37)]
    rows = [(1, "\n".join(["p", *long, "q"])), (2, "\n".join(["x", *long[3:36], "", "y"])), (3, "\n".join(["z", *long[:5], "", *long[5:9], "w", *long[20:23]])), (4, "\n".join(long[10:14] + ["new"] + long[30:34])), (5, "a\na\na\na\na\na\na")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(tuple(r) for r in linededup.maximal_runs(frame, min_chars=1000).collect())
    assert found == [(2, 1, 33, 33), (3, 1, 10, 9), (4, 0, 3, 4), (4, 5, 8, 4), (5, 1, 6, 6)]
    kept = sorted((r.doc_id, r.text) for r in linededup.delete_repeats(frame, min_chars=1000).collect())
    assert kept == cleaned(rows, 4, 1000)
