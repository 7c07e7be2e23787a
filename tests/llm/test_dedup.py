"""Near-dedup, substring dedup and the pipeline against brute force."""

import itertools
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tributary.llm import common, near_dedup, substring_dedup
from tributary.llm.common import WordHashes, components, shingles, text_shingles, word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def edited(rng, text, share):
    return " ".join(f"x{rng.randrange(10**6)}" if rng.random() < share else w for w in text.split(" "))


def corpus(seed=3):
    rng = random.Random(seed)
    base = [prose(rng, rng.randrange(60, 400)) for _ in range(40)]
    rows = list(enumerate(base))
    for i in range(40, 120):
        rows.append((i, edited(rng, rng.choice(base[:12]), rng.choice([0, 0.005, 0.01, 0.02, 0.03, 0.05]))))
    rows += [(120, None), (121, ""), (122, " \n"), (123, "one"), (124, "ONE"), (125, "one two"), (126, "a b c"), (127, base[0]), (127, base[0])]
    return rows


def sets(rows, width):
    out = {}
    for i, text in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        out[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    return out


def reachable(rows, width, percent):
    found = sets(rows, width)
    least = {i: i for i in found}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    for a, b in itertools.combinations(sorted(found), 2):
        both = len(found[a] & found[b])
        if both and 100 * both >= percent * (len(found[a]) + len(found[b]) - both):
            x, y = find(a), find(b)
            least[max(x, y)] = min(x, y)
    return {i: find(i) for i in found}


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, width, percent):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("x", "y")
    got = near_dedup.near_duplicates(docs, width, percent).collect()
    expected = reachable(rows, width, percent)
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got} == expected
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(s) for i, s in sets(rows, width).items()}
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def near_group(seed=4, n=260):
    """One text with edits from few words, at all distances, in whole and cut short; behind them unlike texts."""
    rng = random.Random(seed)
    base = prose(rng, 120).split(" ")
    rows = []
    for i in range(n):
        words = base[: rng.choice([120, 120, 120, 112, 105, 70, 60])]
        for _ in range(rng.randrange(9)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(4)}"
        rows.append((i, " ".join(words)))
    return rows + [(1000 + i, prose(rng, 80)) for i in range(20)]


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_large_group_of_near_copies_equals_brute_force(spark, monkeypatch, width, percent):
    rows, opened, plain = near_group(), [], near_dedup._open
    monkeypatch.setattr(near_dedup, "_open", lambda *x: opened.append(1) or plain(*x))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = near_dedup.near_duplicates(docs, width, percent).collect()
    expected = reachable(rows, width, percent)
    assert {r.doc_id: r.component_id for r in got} == expected
    assert opened and len(set(expected.values())) > 30


def test_large_group_behind_a_common_passage_lays_out_few_shingles(spark, monkeypatch):
    """Texts that share less than a link with their lead: shingles that no partner can have are not laid out."""
    rng = random.Random(8)
    line = prose(rng, 60)
    rows = [(i, f"{line} {prose(rng, 40)}") for i in range(120)] + [(500, f"{line} x y z")] + [(501 + i, f"{line} x y z {i}") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made, lead, plain = [], 500, near_dedup.stash
    monkeypatch.setattr(near_dedup, "stash", lambda df, label: (out := plain(df, label), made.append((label, out.count())))[0])
    sketches = docs.mapInArrow(near_dedup._sketches(3), "doc_id long, n_shingles long, same long, registers binary")
    full = docs.mapInArrow(near_dedup._full(3), "doc_id long, found binary")
    found = near_dedup._Links(sketches, full, spark.createDataFrame([], "a long, b long"), 85)
    group = sketches.selectExpr("1L AS key", "doc_id", "n_shingles AS n", f"{lead}L AS lead")
    groups, pairs = near_dedup._open(found, near_dedup._related(found, group), 85)
    links = {i for pair in pairs.collect() for i in pair} | {r.doc_id for r in groups.collect()}
    assert links == {501 + i for i in range(30)}
    whole = sum(len(s - sets(rows, 3)[lead]) for i, s in sets(rows, 3).items() if i != lead)
    assert 0 < sum(n for label, n in made if label in ("heads", "laid")) < whole / 2


def test_ranges_of_sizes_that_stand_alone_make_one_group(spark):
    found = near_dedup._Links(spark.createDataFrame([], "doc_id long"), None, spark.createDataFrame([], "a long, b long"), 85)
    sizes = {1: 100, 2: 101, 3: 300, 4: 340, 5: 400, 6: 1000}
    rows = spark.createDataFrame([(7, i, n) for i, n in sizes.items()], "key long, doc_id long, n long")
    groups = defaultdict(set)
    for r in near_dedup._by_lead(found, rows, 85).collect():
        groups[r.key].add(r.doc_id)
    assert all(any({a, b} <= g for g in groups.values()) for a, b in ((1, 2), (3, 4), (4, 5)))
    assert sum(map(len, groups.values())) < 2 * len(sizes) and set().union(*groups.values()) == set(sizes)
    assert not any(g < h for g in groups.values() for h in groups.values())


def test_near_duplicates_of_repeated_ids_long_texts_and_string_ids(spark):
    long = prose(random.Random(1), 30_000)
    rows = [("b", "x y z " * 5), ("a", long), ("a", "other text of the same id"), ("c", long + " end"), ("d", "OTHER text of the same id"), ("e", None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string").selectExpr("*", "1 AS key", "2 AS n", "3 AS lead")
    got = {(r.doc_id, r.component_id) for r in near_dedup.near_duplicates(docs).collect()}
    assert got == {("a", "a"), ("b", "b"), ("c", "a"), ("d", "a"), ("e", "e")}


def test_what_near_duplicates_broadcast_is_bounded(spark, monkeypatch):
    held = []
    plain = near_dedup.components
    monkeypatch.setattr(near_dedup, "components", lambda edges: held.append(spark.conf.get("spark.sql.autoBroadcastJoinThreshold")) or plain(edges))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    docs = spark.createDataFrame([(i, " ".join(f"w{(i % 5) * 100 + k}" for k in range(60)) + (" end" if i > 9 else "")) for i in range(20)], "doc_id long, text string")
    monkeypatch.setattr(common, "BROADCAST_IDS", 0)  # all ids by their hashes
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).collect()}
    assert got == {i: i % 5 for i in range(20)}
    assert held and all(int(x) <= common.BROADCAST_BYTES for x in held) and spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == before


@pytest.mark.parametrize("kind", ["long", "string", "struct<a:long,b:string>"])
def test_rows_likely_among_ids(spark, monkeypatch, kind):
    monkeypatch.setattr(common, "BROADCAST_IDS", 10)
    rows = spark.range(3000).select((F.col("id").cast(kind) if kind in ("long", "string") else F.struct(F.col("id").alias("a"), F.lit("x").alias("b"))).alias("doc_id"), "id")
    rows = rows.unionByName(spark.createDataFrame([(None,)], "id long").select(F.lit(None).cast(kind).alias("doc_id"), "id"))
    for n in (0, 7, 500):
        found = [r.id for r in common.likely_among(rows, rows.where(f"id < {n}").select("doc_id")).collect()]
        assert set(range(n)) <= set(found) and len(found) <= n + 2


def test_near_duplicates_of_nothing_and_null_ids(spark):
    schema = "doc_id long, text string, n_shingles string, component string"
    assert near_dedup.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    got = near_dedup.near_duplicates(spark.createDataFrame([(None, "a b", "", ""), (1, "a b", "", "")], schema)).collect()
    assert sorted((r.doc_id or 0, r.component_id, r.kept) for r in got) == [(0, None, True), (1, 1, True)]


def test_registers_estimate_similarity():
    rng = np.random.default_rng(1)
    for share in (0.3, 0.8, 0.95):
        a = rng.integers(0, 2**63, 2000).astype(np.uint64)
        b = a.copy()
        b[: int(2000 * (1 - share) / (1 + share))] = rng.integers(0, 2**63, int(2000 * (1 - share) / (1 + share))).astype(np.uint64)
        a, b = np.unique(a), np.unique(b)
        assert abs(near_dedup.estimate(near_dedup.sketch(a), near_dedup.sketch(b), 2000, 2000) - share) < 0.16
    x = np.array([0, 1, 2, 3, 2**31, 2**32 - 1], np.uint64)
    assert len(set(near_dedup.register(x).tolist())) == len(x)
    assert 0 < near_dedup.collisions(500, 500) < 0.01


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 2), (9, 8), (8, 7), (20, 10), (20, 2), (6, 6)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {5: 2, 4: 2, 3: 2, 2: 2, 20: 2, 10: 2, 9: 7, 8: 7, 7: 7}


def test_word_hashes_equal_words_one_by_one():
    rng = random.Random(2)
    found = [b"", b" \t ", "Ärger a\u00a0b A".encode(), b"x" * 3000 + b" y", bytes(rng.choice(b"aB \x0b\n") for _ in range(600_000)), b"\x0c\ra", b"none"]
    hashes, ends = word_hashes(found)
    known, begin = {}, 0
    for text, end in zip(found, ends.tolist()):
        words = text.lower().split()
        assert len(words) == end - begin
        assert all(known.setdefault(w, h) == h for w, h in zip(words, hashes[begin:end].tolist()))
        begin = end
    assert len(set(known.values())) == len(known) > 300
    begins = [0, *ends.tolist()]
    for width in (3, 5):
        for got, a, b in zip(text_shingles(found, width), begins, ends.tolist()):
            assert got.tolist() == shingles(hashes[a:b], width).tolist()
    assert text_shingles([], 5) == []


def test_compact_windows_are_all_windows_by_definition():
    rng = np.random.default_rng(0)
    for n, least in ((5, 8), (8, 8), (60, 5), (200, 46), (90, 1)):
        h = rng.integers(0, 2**63, n).astype(np.uint64) << np.uint64(1)
        expected = []
        for c in range(n):
            l, r = c, c
            while l and h[l - 1] > h[c]:
                l -= 1
            while r + 1 < n and h[r + 1] > h[c]:
                r += 1
            if r - l + 1 >= least:
                expected.append((l, c, r))
        assert sorted(substring_dedup.compact_windows(h, least), key=lambda w: w[1]) == expected


def passages_corpus():
    rng = random.Random(8)
    shared = [prose(rng, n) for n in (55, 60, 90, 200)]
    line = prose(rng, 30)
    rows = []
    for i in range(60):
        parts = [prose(rng, rng.randrange(10, 120)), line]
        if i % 3:
            parts.insert(rng.randrange(3), shared[i % 4])
        if i % 5 == 0:
            parts.append(edited(rng, shared[3], 0.01))
        rows.append((i, "\n".join(parts)))
    rows += [(100, rows[7][1]), (101, rows[7][1]), (102, "same " * 80), (103, "other words here " + "same " * 70), (104, None), (105, ""), (106, prose(rng, 49))]
    return rows, line


def equal_runs(rows, least=50):
    """doc_id -> places of runs of `least` words that a smaller doc_id has as well."""
    first, words = {}, {}
    for i, text in sorted(rows):
        words[i] = WORD.findall((text or "").lower())
        for k in range(len(words[i]) - least + 1):
            first.setdefault(tuple(words[i][k : k + least]), i)
    return {i: [k for k in range(len(w) - least + 1) if first[tuple(w[k : k + least])] < i] for i, w in words.items()}


def test_passages_cover_all_equal_runs_and_nothing_else(spark):
    rows, line = passages_corpus()
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source_id string")
    spans = defaultdict(list)
    for r in substring_dedup.find_passages(docs).collect():
        assert r.source_id < r.doc_id and r.end_word - r.start_word >= 50
        spans[r.doc_id].append((r.start_word, r.end_word))
    for i, places in equal_runs(rows).items():
        for k in places:
            assert any(a <= k and k + 50 <= b for a, b in spans[i]), (i, k)
    text = dict(rows)
    clean = {i for i in text if i < 60 and i % 3 == 0 and i % 5}
    assert clean.isdisjoint(spans)
    # The words of a passage have near-equal ones elsewhere: of any 50, most runs of five.
    for i, found in spans.items():
        own = WORD.findall(text[i].lower())
        others = {tuple(w[k : k + 5]) for j, t in rows if j != i for w in [WORD.findall((t or "").lower())] for k in range(len(w) - 4)}
        for a, b in found:
            runs = [tuple(own[k : k + 5]) in others for k in range(a, b - 4)]
            assert sum(runs) >= 0.85 * len(runs)


def chains_corpus():
    """Passages of 60 words edited step by step, of which the first and the last are not
    near; and such of two documents behind a line whose first document is another one."""
    rng = random.Random(5)
    line = prose(rng, 30)
    rows = [(0, f"{prose(rng, 80)} {line} {prose(rng, 80)}")]
    for i in range(1, 121, 3):
        words = prose(rng, 60).split(" ")
        for k, at in enumerate((None, 15, 45)):
            if at is not None:
                words[at] = f"x{rng.randrange(10**6)}"
            rows.append((i + k, f"{prose(rng, 40)} {' '.join(words)} {prose(rng, 40)}"))
    for i in range(200, 280, 2):
        words = prose(rng, 26).split(" ")
        rows.append((i, f"{prose(rng, 40)} {line} {' '.join(words)} {prose(rng, 40)}"))
        words[12] = "edited"
        rows.append((i + 1, f"{prose(rng, 40)} {line} {' '.join(words)} {prose(rng, 40)}"))
    return rows


def test_rows_of_a_key_meet_its_lead_after_one_shuffle(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(40), rng.randrange(30), rng.randrange(9), 9, rng.random() < 0.4) for _ in range(150)]
    df = substring_dedup._grouped(spark.createDataFrame(rows, "key long, doc_id long, at int, last int, ask boolean").repartition(3))
    wanted = []
    for key in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == key]
        lead = min(r[1:4] for r in own)
        if any(ask and d > lead[0] for _, d, _, _, ask in own):
            wanted += [(*r, *lead, len(own)) for r in own if r[1] > lead[0]]
    assert sorted(map(tuple, df.collect())) == sorted(wanted) and 0 < len(wanted) < len(rows)
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert "Window" in plan and "Join" not in plan and "Aggregate" not in plan


def test_near_passages_of_chains_and_behind_a_line(spark):
    rows = chains_corpus()
    hashes = WordHashes()
    s = {i: (shingles(hashes.of([w.encode() for w in t.split(" ")]), 5) >> np.uint64(32)).astype(np.uint32) for i, t in rows}
    near = defaultdict(set)
    for a, b in itertools.combinations(sorted(s), 2):
        for begin, end, _ in substring_dedup.passages(s[b], s[a]):
            near[b] |= set(range(begin, end - 45))
    found = defaultdict(set)
    for r in substring_dedup.find_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert r.source_id < r.doc_id
        found[r.doc_id] |= set(range(r.start_word, r.end_word - 49))
    assert not any(found[i] - near[i] for i in found)
    recall = lambda ids: sum(bool(found[i] & near[i]) for i in ids) / len(ids)
    chained, behind = [i for i in near if i < 200 and i % 3 == 0], [i for i in near if i >= 200]
    assert len(chained) == 40 and len(behind) >= 40
    assert min(recall(chained), recall(behind)) >= 0.99, (recall(chained), recall(behind))


def test_removal_keeps_one_copy_and_the_rest_of_the_text(spark):
    rows, _ = passages_corpus()
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, __x string")
    left = {r.doc_id: r.text for r in substring_dedup.remove_passages(docs).collect()}
    assert not {100, 101} & set(left) and left[104] is None and left[105] == ""
    kept = [(i, t) for i, t in left.items() if t]
    assert sum(map(len, equal_runs(kept).values())) == 0
    assert all(left[i] == t for i, t in rows if i < 60 and i % 3 == 0 and i % 5)
    assert substring_dedup.find_passages(docs.limit(0)).count() == 0


def test_cut_and_passages():
    assert substring_dedup.cut(b"a b  c\nd e", [(1, 3)]) == b"a d e"
    assert substring_dedup.cut(b"a b", [(0, 2)]) == b""
    words = [f"w{k}" for k in range(300)]
    hashes = WordHashes()
    hashed = lambda x: shingles(hashes.of([w.encode() for w in x]), 5)
    s, changed = hashed(words[50:250]), words[:]
    changed[150] = "other"
    (found,) = substring_dedup.passages(s, hashed(["q"] * 30 + changed[20:280]))
    assert found == (0, len(s), 60)
    # Two edits within a run part the stretch: runs that hold both are no near-duplicates.
    changed[160:160] = ["put", "in"]
    found = substring_dedup.passages(s, hashed(["q"] * 30 + changed[20:280]))
    assert found[0][0] == 0 and found[-1][1] == len(s) and all(b - a >= 46 for a, b, _ in found)


def test_pipeline_columns_and_stages(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    names = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, tiny).toPandas(), docs.schema)
        assert docs.columns == names
        assert docs.where("n_chars <> length(text)").count() == 0
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, tiny)
    assert sorted(mixed.columns) == sorted(["doc_id", "size", "source_size", "target", "taken"])
    assert 0 < mixed.count() == docs.count()
    assert reachable([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], 5, 80)
    whole = corpus_pipeline.run(spark, tiny)
    assert sorted(whole.collect()) == sorted(mixed.select(whole.columns).collect())


def test_pipeline_stages_on_odd_tables(spark, tiny):
    rows = [(1, None, 0), (2, "", 0), (3, "One good sentence of words here. " * 30, 5), (3, "One good sentence of words here. " * 30, 5)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").selectExpr("*", "'s' AS source", "1 AS kept", "2 AS __words", "3 AS clean", "4 AS cuts", "5 AS whole")
    for docs in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, tiny)
            assert out.columns == odd.columns and all(r.kept == 1 and r.whole == 5 for r in out.collect())
        assert corpus_pipeline.STAGES[-1][1](spark, docs, tiny).count() == docs.count()


def test_rows_of_one_id_with_other_texts_are_kept_apart(spark):
    rng = random.Random(21)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    passage, own = prose(80), prose(200)
    first = f"{prose(30)} {passage} {prose(30)}"
    rows = [(1, first), (2, f"{prose(40)} {passage} {prose(20)}"), (2, own), (5, prose(90)), (6, prose(10)), (None, passage), (7, None)]
    rows += [(6, rows[3][1]), (6, prose(300))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS own")
    left = substring_dedup.remove_passages(docs).collect()
    assert sorted(left[0].asDict()) == ["doc_id", "own", "text"]
    kept = {(r.doc_id, r.text) for r in left}
    untouched = [r for k, r in enumerate(rows) if k not in (1, 7)]
    assert set(untouched) <= kept and len(left) == len(untouched) + 1
    (cut,) = kept - set(untouched)
    assert cut[0] == 2 and len(cut[1].split()) <= 60 and not set(passage.split()[10:70]) & set(cut[1].split())
    found = substring_dedup.find_passages(docs).collect()
    assert {(r.doc_id, r.source_id) for r in found} == {(2, 1), (6, 5)} and found[0].asDict().keys() == {"doc_id", "source_id", "start_word", "end_word", "source_start"}
