"""Suffix-array dedup, n-gram join and decontamination against brute force."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestack.llm import induced_sort, ngram_join, suffix_dedup, template_decontamination
from tests.llm import brute


def letters(s):
    out, k = [], 0
    last = int((s == induced_sort.SEPARATOR).sum())
    for x in s:
        if x == induced_sort.SEPARATOR:
            k += 1
            out.append((1, k if k < last else -1))
        else:
            out.append((int(x), 0))
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=25).map(lambda b: bytes(97 + c % 3 for c in b)), min_size=1, max_size=6))
def test_suffix_array_and_prefixes(texts):
    s = induced_sort.joined(texts)
    plain = letters(s)
    order = induced_sort.suffix_array(s)
    assert order.tolist() == sorted(range(len(s)), key=lambda i: plain[i:])
    ends = np.append(np.flatnonzero(s == induced_sort.SEPARATOR), len(s) - 1)
    until = ends[np.searchsorted(ends, np.arange(len(s)))] - np.arange(len(s))
    lcp = induced_sort.permuted_lcp(s, order, until)
    for a, b in zip(order[:-1], order[1:], strict=True):
        n = 0
        while max(a, b) + n < len(s) and plain[a + n] == plain[b + n]:
            n += 1
        assert lcp[b] == n


def test_recursion_on_names_of_repetitive_strings(monkeypatch):
    depth = []
    order_of = induced_sort._order
    monkeypatch.setattr(induced_sort, "_order", lambda names: depth.append(len(names)) or order_of(names))
    fib = [b"b", b"a"]
    while len(fib[-1]) < 2000:
        fib.append(fib[-1] + fib[-2])
    rng = random.Random(1)
    cases = [[fib[-1]], [b"ab" * 700, b"ab" * 500], [b"a" * 900], [b"abac" * 300 + b"abad"], [bytes(rng.choice(b"ab") for _ in range(2500))], [fib[-2], fib[-1], b"b" + fib[-3]]]
    deepest = 0
    for texts in cases:
        depth.clear()
        s = induced_sort.joined(texts)
        plain = letters(s)
        assert induced_sort.suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: plain[i:])
        assert all(2 * b <= a for a, b in zip(depth, depth[1:], strict=False))
        deepest = max(deepest, len(depth))
    assert deepest >= 4


def repeat_cases():
    rng = random.Random(5)
    base = "".join(rng.choice("abcdefgh ") for _ in range(900))
    docs = [(0, base), (1, base[100:350] + "XYZ" + base[350:700]), (2, "a" * 500), (3, "q" + "a" * 300), (4, "ab" * 200), (5, None), (6, ""), (7, base), (8, base[:99]), (9, base[:100])]
    docs += [(10, "é" * 120 + base[5:150]), (11, "é" * 80), (12, "".join(rng.choice("ab") for _ in range(3000))), (13, base * 3)]
    for k in range(14, 50):
        x = list(base)
        for _ in range(k % 7):
            x[rng.randrange(900)] = "Z"
        a = rng.randrange(500)
        docs.append((k, "".join(x)[a : a + rng.randrange(400)] + str(k) * 20 + base[: rng.randrange(300)]))
    return docs


@pytest.mark.parametrize("hot,loose", [(suffix_dedup.HOT, suffix_dedup.LOOSE), (1, 1), (3, 100), (100, 2)])
def test_repeats_are_those_of_brute_force(spark, monkeypatch, hot, loose):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "LOOSE", loose)
    docs = repeat_cases()
    monkeypatch.setattr(suffix_dedup, "PIECE", 1 << 20 if hot > 3 else 600)  # the latter cuts the longest of these texts
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 2000)
    frame = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in docs], "doc_id long, text string, kept string, __doc int, __text string").repartition(3)
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(frame, ["doc_id", "kept", "__doc", "__text"], ["n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"], prefix="new_").collect()}
    want = brute.repeats(docs)
    assert {k: (r.new_n_bytes, r.new_n_removed, r.new_n_spans, r.new_kept_sha256) for k, r in got.items()} == {k: (a, b, c, brute.digest(d)) for k, (a, b, c, d) in want.items()}
    assert all(sum(b - a for a, b in r.new_spans) == r.new_n_removed and (r["__doc"], r["__text"]) == (1, "y") for r in got.values())
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(frame, ["kept"], ["kept"])


def test_repeats_of_repeated_rows_nulls_and_empty_tables(spark):
    text = "0123456789abcdef" * 20
    frame = spark.createDataFrame([(1, "left " + text), (1, "left " + text), (2, text), (None, text[:150])], "doc_id long, text string")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_removed) for r in suffix_dedup.remove_repeats(frame, ["doc_id"], ["n_removed"]).collect())
    one = brute.repeats([(-1, text[:150]), (1, "left " + text), (2, text)])
    assert got == [(-1, one[-1][1]), (1, one[1][1]), (1, one[1][1]), (2, one[2][1])]
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string"), ["doc_id"], ["n_removed"]).count() == 0


def test_rows_of_one_id_and_without_one_have_covers_of_their_own(spark):
    rng = random.Random(6)
    base, *other = ["".join(rng.choice("abcdefgh ") for _ in range(300)) for _ in range(5)]
    docs = [(None, other[0] + base), (None, other[1]), (3, other[2]), (3, other[3] + base[:200]), (3, other[2]), (4, base)]
    order = sorted({(-1 if i is None else i, suffix_dedup.hashlib.sha256(t.encode()).hexdigest(), t) for i, t in docs})
    want = {(i, t): cut for (i, _, t), cut in zip(order, brute.repeats([(k, t) for k, (_, _, t) in enumerate(order)]).values(), strict=True)}
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = suffix_dedup.remove_repeats(frame, ["doc_id", "text"], ["n_removed", "kept"]).collect()
    key = lambda i, t: (-1 if i is None else i, t)
    assert sorted((*key(r.doc_id, r.text), r.n_removed, bytes(r.kept)) for r in got) == sorted((*key(i, t), want[key(i, t)][1], want[key(i, t)][3]) for i, t in docs)


def test_long_text_in_pieces_has_the_same_minimisers():
    rng = np.random.default_rng(1)
    buf = rng.integers(97, 101, 5000).astype(np.uint8)
    whole = suffix_dedup.minimisers(buf, np.array([0, 5000]))
    parts = suffix_dedup._piecewise(buf, np.array([0, 5000]), step=700)
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))


def join_cases():
    rng = random.Random(9)
    words = [f"w{k}" for k in range(400)]
    base = [rng.choice(words) for _ in range(120)]
    line = [rng.choice(words) for _ in range(12)]
    docs = [(500, " ".join(base)), (3, " ".join(base)), (4, None), (5, ""), (6, "one two"), (7, "One  TWO\n"), (8, "\t \n"), (9, "a a a a a a a a a a"), (10, "a a a a a a")]
    for k in range(20, 110):
        x = list(base)
        for _ in range(k % 9):
            x[rng.randrange(len(x))] = rng.choice(words)
        docs.append((k, " ".join(x).upper() if k % 2 else " ".join(x)))
    for k in range(200, 260):  # short texts that share a line and little else
        docs.append((k, " ".join(line + [rng.choice(words) for _ in range(k % 6)])))
    docs += [(k, " ".join(rng.choice(words) for _ in range(60))) for k in range(300, 320)]
    return docs


@pytest.mark.parametrize("small,kw", [(32, {}), (2, {"block": 16}), (4, {"cell": 5, "block": 7}), (3, {"block": 1000, "weight": 300})])
def test_components_are_those_of_brute_force(spark, monkeypatch, small, kw):
    monkeypatch.setattr(ngram_join, "SMALL", small)
    docs = join_cases()
    frame = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, key int").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(frame, **kw).collect()}
    assert got == brute.components(docs)


def test_one_line_in_every_document(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SMALL", 4)
    rng = random.Random(21)
    words = [f"w{k}" for k in range(90)]
    line = " ".join(f"line{k}" for k in range(30))
    docs = []
    for k in range(120):  # the line is most of a text, so that all meet in its shingles
        own = [rng.choice(words) for _ in range(rng.choice([1, 3, 6, 9, 14, 40, 41]))]
        docs.append((k, line + " " + " ".join(own) if k % 3 else " ".join(own) + " " + line))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), block=9, weight=500).collect()}
    assert got == brute.components(docs)


def test_components_of_repeated_rows_null_ids_and_empty_tables(spark):
    text = "alpha beta gamma delta epsilon zeta"
    frame = spark.createDataFrame([(7, text), (7, text), (None, text), (None, "other words entirely here now"), (9, text + " " + "x " * 50)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(frame).collect() if r.component_id is not None)
    assert got == [(-1, 2, 7), (7, 2, 7), (7, 2, 7), (9, len(brute.shingles(text + " " + "x " * 50)), 9)]
    assert ngram_join.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_near_copy_stage_tells_rows_of_one_id_and_without_one_apart(spark):
    rng = random.Random(3)
    base, *other = [[f"{k}w{rng.randrange(900)}" for _ in range(60)] for k in range(6)]
    near, far = [*base[:10], "new", *base[11:]], [*base[:10], "new", *base[11:40], "more", *base[41:]]
    docs = [(5, base), (None, near), (None, far), (7, other[0]), (7, other[0]), (8, other[1]), (8, other[2]), (8, near), (None, other[3]), (None, other[4])]
    docs = [(i, " ".join(w)) for i, w in docs]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    text = lambda w: " ".join(w)
    named = {(r.text, r.component_id) for r in frame.join(ngram_join.jaccard_components(frame), "doc_id").filter("doc_id = 5").collect()}
    assert named == {(text(base), 5)}
    assert sorted(r.n for r in ngram_join.jaccard_components(frame).filter("doc_id is null").groupBy("component_id").agg(F.count("*").alias("n")).collect()) == [2, 2]
    named = frame.withColumns({n: F.lit(7) for n in ("__key", "__check", "__id", "key", "label")})
    kept = ngram_join.near_copy_stage(spark, named, "")
    assert kept.columns == named.columns
    got = sorted((r.doc_id or -1, r.text) for r in kept.filter("__key = 7 AND label = 7").collect())
    assert got == sorted([(5, text(base)), (7, text(other[0])), (8, text(other[1])), (8, text(other[2])), (-1, text(other[3])), (-1, text(other[4]))])


def test_prefix_grows_only_where_it_is_cheap():
    own = np.arange(1, 101, dtype=np.uint64)
    token, level, chosen, _ = ngram_join.prefix(own, np.zeros(0, np.uint64), np.zeros(0, np.int64))
    assert chosen == ngram_join.MOST and len(token) == 100 - 80 + chosen and level.max() == chosen
    heavy, seen = np.arange(22, 101, dtype=np.uint64), np.full(79, 100_000)
    token, level, chosen, _ = ngram_join.prefix(own, heavy, seen)
    assert chosen == 1 and token.tolist() == list(range(1, 22))


QUESTION = "It takes Anna 12 minutes to walk 3 km along the river, and then Anna rests for 12 minutes at home near the old mill."


def test_reparameterised_questions_are_found(spark):
    docs = [
        (0, QUESTION), (1, QUESTION.replace("Anna", "Bertha").replace("12", "15").replace("3 km", "4 km")), (2, QUESTION.replace("Anna", "Bertha").replace("for 12", "for 17")),
        (3, "Nothing like this text at all, but of a similar length, and with 12 minutes in it for a change, as they say here."), (4, None), (5, ""), (6, "padding " * 3000 + QUESTION.upper()),
        (0, QUESTION), (7, "short one"),
    ]
    items = [(70, QUESTION), (71, "short one"), (72, None), (73, "!!!"), (70, QUESTION)]
    frame = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, w int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for most in (200_000, 0):
        got = {(r.doc_id, r.item_id) for r in template_decontamination.contaminated(frame, bench, broadcast_rows=most).collect()}
        assert got == {(0, 70), (1, 70), (6, 70), (7, 71)}
    empty = spark.createDataFrame([], "item_id long, text string")
    assert template_decontamination.contaminated(frame, empty).count() == 0
    assert template_decontamination.contaminated(frame.limit(0), bench).count() == 0


def test_questions_are_found_in_any_case_and_layout(spark):
    """Verbatim items re-wrapped, with doubled blanks, in capitals or small letters; other names at the start of sentences."""
    item = "Maria has 12 apples and lives in Rome with Otto. Peter gives Maria 7 apples, which weigh 2 kg, before he leaves Rome."
    wrapped = item.replace(" Rome", "\nRome").replace(" 7 ", "  7\t").replace("2 kg", "2\r\n kg")
    renamed = item.replace("Maria", "Clara").replace("12", "30").replace("Rome", "Oslo").replace("Otto", "Hugo").replace("Peter", "Franz")
    docs = {0: item, 1: wrapped, 2: item.upper(), 3: item.lower(), 4: renamed, 5: renamed.replace(" ", "\n"), 6: "Intro. " + wrapped.upper() + " End.", 7: renamed.replace("before he leaves Oslo", "before he leaves Rome")}
    clean = {20: "Maria has a garden and lives in Rome.", 21: "Clara Franz Hugo Oslo Paul Rita Nina Karl Emil Anton", 22: "30 apples, 7 kg"}
    titles = "Red Harbour Night Market Opens Again After Long Winter Storms"
    docs[8] = f"see {titles}"
    clean[23] = "see Old Mountain Train Station Closes Early Before Short Summer Rains"
    frame = spark.createDataFrame(list((docs | clean).items()), "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, titles), (3, "Blue Whale")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in template_decontamination.contaminated(frame, bench).collect()}
    want = {(i, j) for i, t in (docs | clean).items() for j, q in ((1, item), (2, titles), (3, "Blue Whale")) if brute.holds(t, q)}
    assert got == want and {i for i, _ in got} >= set(range(7)) | {8} and not {i for i, _ in got} & set(clean)
    short = spark.createDataFrame([(1, "blue\nWHALE!"), (2, "Red Fox"), (3, "a Blue Whale")], "doc_id long, text string")
    assert [(r.doc_id, r.item_id) for r in template_decontamination.contaminated(short, bench).collect()] == [(1, 3)]


def test_a_question_is_found_on_any_consistent_alignment(spark):
    bakery = "The baker sells 12 loaves and 30 rolls each morning before the shop opens, says the old man at the door."
    torn = QUESTION.replace("Anna", "Bertha").replace("for 12", "for 17")
    part = QUESTION[: QUESTION.index(" at home")]
    docs = [
        (0, bakery.replace("12", "15").replace("30", "15")),  # two values of the item fall together
        (1, part.replace("for 12", "quietly") + " 99 of them were seen there by us near the very old mill, 12 of which Anna took."),  # other values outside the matched windows
        (2, torn + " " + "filler " * 20 + QUESTION),  # the later of two alignments is consistent
        (3, torn),
    ]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(70, QUESTION), (71, bakery)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in template_decontamination.contaminated(frame, bench).collect()} == {(0, 71), (1, 70), (2, 70)}


def test_templates_line_up_with_slots(spark):
    frame = spark.createDataFrame([(QUESTION,), ("In 1,200.5 kg of it, Bob-like 3-4 cm, 7.",), ("end 12. Next 5,6,7 x",), ("",)], "t string")
    for r in frame.select(template_decontamination.template(F.col("t")).alias("a"), template_decontamination.slots(F.col("t")).alias("b")).collect():
        marks = (template_decontamination.NUMBER, template_decontamination.UNIT, template_decontamination.NAME)
        assert [w[0] if w[0] in marks else w for w in r.b] == r.a


def template_cases():
    rng = random.Random(11)
    words = "walks river mill bread along under house takes the of and then from old stone bridge rests each morning".split()
    names, units = ["Anna", "Bertha", "Carl", "Dora"], ["km", "minutes", "kg", "euros"]

    def question(k):
        own = random.Random(k)
        return [own.choice(words) if own.random() < 0.8 else own.choice([f"{{n{own.randrange(3)}}}", f"{{a{own.randrange(2)}}} {{u{own.randrange(2)}}}", f"{{a{own.randrange(2)}}}"]) for _ in range(14 + k)]

    def filled(q, torn=False):
        values = {f"n{k}": n for k, n in enumerate(rng.sample(names, 3))} | {f"a{k}": str(rng.randrange(2, 99)) for k in range(2)} | {f"u{k}": u for k, u in enumerate(rng.sample(units, 2))}
        out = []
        for w in q:
            if torn and "{" in w and rng.random() < 0.5:
                values = dict(values, **{f"a{k}": str(rng.randrange(2, 99)) for k in range(2)}, n0=rng.choice(names))
            out.append(w.format(**values))
        return "So " + " ".join(out)

    questions = [question(k) for k in range(12)]
    items = [(k, filled(q)) for k, q in enumerate(questions)] + [(100, "river"), (101, "the old stone"), (102, "bread and the bridge"), (103, None), (104, "..."), (None, filled(questions[3])), (5, filled(questions[5]))]
    docs = []
    for k in range(90):
        q = questions[k % 12]
        cut = q[rng.randrange(6) :] if k % 3 == 0 else q
        docs.append((k, " ".join(rng.choice(words) for _ in range(rng.randrange(20))) + ". " + filled(cut, torn=k % 4 == 1) + (". " + filled(q, torn=k % 5 == 0) if k % 7 == 0 else "")))
    docs += [(200, "River!"), (201, "THE old stone."), (202, "x bread and the bridge y"), (203, None), (204, ""), (None, filled(questions[3])), (None, filled(questions[4], torn=True)), (7, filled(questions[2])), (205, f"a {template_decontamination.NAME}b{template_decontamination.NUMBER} 7 bread and the bridge")]
    return docs, items


@pytest.mark.parametrize("most", [200_000, 0])
def test_decontamination_is_that_of_brute_force(spark, most):
    docs, items = template_cases()
    want = {(i, j) for i, t in docs for j, q in items if t and q and brute.holds(t, q)}
    assert {(200, 100), (201, 101), (202, 102), (205, 102)} <= want and any(i is None for i, _ in want) and any(j is None for _, j in want)
    frame = spark.createDataFrame([(i, t, "c") for i, t in docs], "doc_id long, text string, item string").repartition(3)
    got = [(r.doc_id, r.item_id) for r in template_decontamination.contaminated(frame, spark.createDataFrame(items, "item_id long, text string"), broadcast_rows=most).collect()]
    assert set(got) == want and len(got) == len(want)


def test_decontamination_stage_judges_rows_without_an_id_by_their_own_text(spark, tmp_path):
    spark.createDataFrame([(None, QUESTION)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = [(None, QUESTION), (None, "clean text"), (None, None), (3, QUESTION), (3, "other clean text"), (3, QUESTION.replace("Anna", "Bertha").replace("for 12", "for 17"))]
    frame = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(docs)], "doc_id long, text string, __row int")
    kept = template_decontamination.decontamination_stage(spark, frame, str(tmp_path))
    assert kept.columns == frame.columns and sorted(r["__row"] for r in kept.collect()) == [1, 2, 4, 5]
