"""Operators with fitted models, decontamination, mixing and the pipeline."""

import random
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.helpers import SF, hard_rows, table, words
from wavecrest.llm import decontaminate, labelled, mixing, neardup, quality, toxicity

FULL = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    return {t: spark.read.parquet(f"{FULL}/{t}.parquet") for t in ("documents", "labels", "benchmark")}


def held_out(scored, labels, target):
    joined = scored.join(labels.where(f"{target} IS NOT NULL"), "doc_id").where(labelled.crc_fold(F.col("doc_id")) == 2)
    return joined.toPandas()


# operator 3


def test_toxicity_held_out(spark):
    out = toxicity.op3_toxicity(spark, FULL)
    assert out.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    got = held_out(out, spark.read.parquet(f"{FULL}/labels.parquet"), "toxic")
    assert got.held_out.all() and got.score.between(0, 1).all()
    order = np.argsort(np.argsort(got.score))
    toxic = got.toxic == 1
    area = (order[toxic].mean() - (toxic.sum() - 1) / 2) / (~toxic).sum()
    assert area > 0.95
    assert ((got.score >= 0.3) == (got.predicted == 1)).all()


def test_toxicity_learns_pairs():
    """Toxic only where both terms meet: more than additive weights can say."""
    rng, sets, labels = np.random.RandomState(3), [], []
    for _ in range(4000):
        a, b = rng.rand(2) < 0.4
        sets.append(np.unique(np.concatenate([rng.randint(100, 400, 12), [1] * int(a), [2] * int(b)])).astype(np.int32))
        labels.append(float(a and b))
    model = toxicity.fit(np.array(labels[:3000]), sets[:3000])
    scores = model.scores(sets[3000:])
    assert ((scores > 0.5) == (np.array(labels[3000:]) == 1)).mean() > 0.97
    base, both = model.scores([np.array([], np.int32), np.array([1, 2], np.int32)])
    logit = lambda p: np.log(p / (1 - p))
    one, two = model.scores([np.array([1], np.int32), np.array([2], np.int32)])
    assert logit(both) > logit(one) + logit(two) - logit(base)


def test_scores_without_labels(spark):
    docs, none = table(spark, hard_rows(), extra=True), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.score(docs, toxicity.train(docs, none)).collect()} <= {0.0, 1e-6}
    assert quality.score(docs, none).where("posterior__ < 0.5 OR posterior__ IS NULL").count() == 0
    odd = spark.createDataFrame([(1, None, None), (None, 1, 1), (2, 1, 0), (2, 1, 1), (99999, 0, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.score(docs, toxicity.train(docs, odd)).count() == docs.count()
    empty = table(spark, [])
    assert toxicity.score(empty, toxicity.train(empty, odd)).count() == 0
    assert quality.score(empty, odd).count() == 0
    assert mixing.mix(empty, odd).count() == 0


# operator 8


def test_quality_held_out(spark):
    out = quality.op8_quality(spark, FULL)
    got = held_out(out, spark.read.parquet(f"{FULL}/labels.parquet"), "quality")
    assert (got.kept == (got.quality == 1)).mean() > 0.98
    good = got[got.quality == 1]
    assert good.kept.mean() > 0.99


def test_sites_shrink(spark):
    """A large bad site pulls a doubtful document down, a site of one document hardly does."""
    from wavecrest.llm._scratch import Scratch

    rows = [(i, "big", "x", 0.02) for i in range(400)] + [(1000 + i, "good", "x", 0.97) for i in range(400)]
    rows += [(5000, "big", "x", 0.6), (5001, "good", "x", 0.6), (5002, "alone", "x", 0.6), (5003, None, None, 0.6)]
    scored = spark.createDataFrame(rows, "doc_id long, source string, lang string, p__ double")

    table_ = quality.sites(scored, 0.5, "source", "lang", Scratch(spark, "test"))
    out = {r.doc_id: r.posterior__ for r in quality.posterior(scored, table_, "source", "lang", 0.5).where("doc_id >= 5000").collect()}
    assert out[5000] < 0.2 < 0.45 < out[5002] < out[5001] and abs(out[5003] - out[5002]) < 0.1


def test_toxicity_against_brute_force(spark):
    """Every pair of terms summed one by one, from the words of the text; folds by zlib."""
    import zlib

    import xxhash

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.train(docs, labels, ~labelled.held_out(F.col("doc_id")))
    got = {r.doc_id: r for r in toxicity.op3_toxicity(spark, SF).collect()}
    assert len(got) == docs.count()
    for doc_id, text in [(r.doc_id, r.text) for r in docs.collect()][:120]:
        terms = {xxhash.xxh3_64_intdigest(w.strip(labelled.EDGE), 1) % labelled.BUCKETS for w in (text or "").encode().lower().split()}
        used = [int(model.slot[t]) for t in sorted(terms) if model.slot[t] >= 0]
        raw = model.bias + sum(model.w[i] * model.x[i] for i in used)
        raw += sum(float(model.v[i] @ model.v[j]) * model.x[i] * model.x[j] for k, i in enumerate(used) for j in used[k + 1 :]) / max(1, len(used)) ** 0.5
        assert got[doc_id].score == pytest.approx(1 / (1 + np.exp(-np.clip(raw, -40, 40))), abs=2e-6)
        assert got[doc_id].held_out == (zlib.crc32(str(doc_id).encode()) % 4 == 2)


def test_quality_posterior_against_brute_force(spark):
    """Shrinkage and posterior recomputed with loops, each document taken out of its own sites."""
    from wavecrest.llm._scratch import Scratch

    rng = random.Random(6)
    rows = []
    for i in range(240):
        host = rng.choice(["a", "b", "c", None, "d"])
        rows.append((i, host, rng.choice(["x", "y", None]) if host != "d" else f"only{i}", min(1 - 1e-6, max(1e-6, rng.betavariate(2, 1) * (0.3 if host == "b" else 1)))))
    scored = spark.createDataFrame(rows, "doc_id long, source string, lang string, p__ double")
    made = quality.sites(scored, 0.7, "source", "lang", Scratch(spark, "test"))
    got = {r.doc_id: r.posterior__ for r in quality.posterior(scored, made, "source", "lang", 0.7).collect()}

    def kappa(site):
        groups = {}
        for r in rows:
            groups.setdefault(site(r), []).append(r[3])
        n, k = len(rows), len(groups)
        mean = sum(r[3] for r in rows) / n
        within = sum((p - sum(g) / len(g)) ** 2 for g in groups.values() for p in g) / (n - k)
        between = (sum(len(g) * (sum(g) / len(g) - mean) ** 2 for g in groups.values()) - (k - 1) * within) / (n - sum(len(g) ** 2 for g in groups.values()) / n)
        return min(1e6, max(1.0, within / between)) if between > 0 else 1e6

    host_kappa, path_kappa = kappa(lambda r: r[1]), kappa(lambda r: (r[1], r[2]))
    mean = sum(r[3] for r in rows) / len(rows)
    odds = lambda p: np.log(p / (1 - p))
    for doc_id, host, path, p in rows:
        others = [r[3] for r in rows if r[0] != doc_id and r[1] == host]
        own = [r[3] for r in rows if r[0] != doc_id and r[1:3] == (host, path)]
        host_mean = (mean * host_kappa + sum(others)) / (len(others) + host_kappa)
        path_mean = (host_mean * path_kappa + sum(own)) / (len(own) + path_kappa)
        assert got[doc_id] == pytest.approx(1 / (1 + np.exp(-(odds(p) + odds(path_mean) - odds(0.7)))), abs=1e-9)


def test_quality_learns_terms():
    """Texts of one shape that differ in their words alone."""
    rng = random.Random(12)
    good, bad = words(rng, 150).split(), words(rng, 150).split()
    make = lambda y: " ".join(rng.choice(good if y and rng.random() < 0.6 else bad if rng.random() < 0.75 else good) for _ in range(40)).encode()
    labels = np.array([float(i % 3 > 0) for i in range(900)])
    texts, terms = [make(y) for y in labels], labelled.Terms()
    sets, shapes = [terms.of(t) for t in texts], np.array([labelled.style(t) for t in texts])
    model = quality.learn(labels[:600], sets[:600], shapes[:600])
    assert ((model.probabilities(texts[600:], sets[600:]) > 0.5) == labels[600:]).mean() > 0.9


def test_rows_without_ids_and_repeated_labelled_rows(spark, tmp_path):
    rng = random.Random(2)
    rows = [*hard_rows(), *[(5, words(rng, 30), "en", "s", 1)] * 300, (6, words(rng, 30_000), "en", "s", 1)]
    folder = f"file://{tmp_path}/t"
    table(spark, rows, extra=True).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 2), int(i % 3 == 0)) for i in range(24)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    for query in (toxicity.op3_toxicity, quality.op8_quality):
        got = query(spark, folder).collect()
        assert len(got) == len(rows) and all(r.held_out is False for r in got if r.doc_id is None)
        assert all(0 <= r.score <= 1 for r in got)
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    y, sets, shapes = labelled.training_rows(docs, labelled.sample(labels, "toxic"), most_terms=50)
    assert len(y) == len(sets) == len(shapes) == 24 and max(map(len, sets)) <= 50
    mixed = mixing.mix(docs, labels, columns=docs.columns)
    assert mixed.count() == len(rows) and set(mixed.columns) == {*docs.columns, *mixing.MADE}


# operator 10


def test_leaks_and_templates(spark):
    rng = random.Random(4)
    question = "Yesterday Maria walked 14 miles from Boston to Salem and Maria then rode 27 miles back home before she counted all of the coins"
    items = [(1, question), (2, words(rng, 30)), (3, "tiny item"), (4, None), (4, words(rng, 6))]
    changed = question.replace("Maria", "Peter").replace("14", "31").replace("27", "8").replace("Boston", "Oslo").replace("Salem", "Bergen")
    inconsistent = changed.replace("Peter then", "Olga then")
    rows = [
        (10, f"{words(rng, 40)}. {question}. {words(rng, 20)}"),
        (11, f"{words(rng, 9)}. {changed}! {words(rng, 9)}"),
        (12, f"{words(rng, 9)}. {inconsistent}. {words(rng, 9)}"),
        (13, f"{words(rng, 60)} tiny item {items[1][1][:40]}"),
        (14, items[1][1].upper().replace(" ", "!! ")),
        (15, f"a {items[4][1]} b"),
        (16, None),
        (17, ""),
        (None, question),
    ]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.found_as for r in decontaminate.find_leaks(docs, bench).collect()}
    assert got == {(10, 1): "verbatim", (11, 1): "template", (14, 2): "verbatim", (15, 4): "verbatim", (None, 1): "verbatim"}
    kept = decontaminate.remove_contaminated(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {12, 13, 16, 17}
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_leaks(docs, none).count() == 0 and decontaminate.remove_contaminated(docs, none).count() == len(rows)


def leak(question, text):
    """One document against one item, without Spark: (item id, matched words, item words, found as)."""
    import pyarrow as pa

    batch = lambda **columns: iter([pa.RecordBatch.from_pydict(columns)])
    (index,) = pa.Table.from_batches(list(decontaminate._index(batch(item=[1], item_id=[1], text=[question]), 8, decontaminate.arrow_of(decontaminate.INDEX)))).to_pylist()
    every = SimpleNamespace(value=np.full(decontaminate.NEED_BITS // 8, 255, np.uint8))
    widths = sorted({w["w"] for w in index["windows"] if w["typed"] != decontaminate.LINE})
    hits = [r for b in decontaminate._hits(batch(row=[7], doc_id=[7], text=[text]), widths, every) for r in b.to_pylist()]
    slots = (decontaminate.TYPED, decontaminate.OPENED)
    rows = [{"row": 7, "doc_id": 7, "item": 1, "shift": h["place"] - w["there"], "there": w["there"], "w": w["w"], "typed": max(h["typed"], w["typed"]), "words": h["words"]}
            for h in hits for w in index["windows"] if (h["h"], h["w"]) == (w["h"], w["w"]) and (h["typed"] in slots) == (w["typed"] in slots)]
    rows.sort(key=lambda r: (r["shift"], r["there"]))
    head = {"row": 7, "doc_id": 7, "item": 1, "item_id": 1} | {c: index[c] for c in ("literal", "kind", "named")}
    table_ = pa.Table.from_pylist([{c: r.get(c) for c in decontaminate.JUDGE} for r in [head, *rows]])
    made = [r for b in decontaminate._judge(iter(table_.to_batches()), 13, decontaminate.arrow_of(decontaminate.FOUND)) for r in b.to_pylist()]
    return [(r["item_id"], r["matched_words"], r["item_words"], r["found_as"]) for r in made]


def test_leaks_with_slots_that_become_equal():
    question = "there were 3 red and 5 green apples in the old basket and 9 more were put in by hand"
    assert leak(question, question.replace("3", "4").replace("5", "4").replace("9", "12"))
    # equal values that become different are another shape
    assert not leak(question.replace("5", "3"), question.replace("3", "4").replace("9", "12"))
    # a clash between two runs of matched windows leaves each of them
    tail = "then all 3 of them walked slowly over the narrow bridge to the other side of the river"
    assert leak("we saw 3 birds fly over the hill at dawn today while it rained so hard " + tail, "we saw 7 birds fly over the hill at dawn today but the sun shone brightly " + tail.replace("3", "8"))


def test_leaks_with_names_that_begin_sentences():
    short = "Maria buys 4 pens for 3 dollars each; what is her total?"
    assert leak(short, "We asked this. " + short.replace("Maria", "Peter").replace("4", "7"))
    assert leak(short, "we asked, Peter buys 7 pens for 9 dollars each; what is her total?")
    question = "Tom has 3 apples. Tom buys 5 more apples. How many apples does Tom have now?"
    changed = question.replace("Tom", "Anna").replace("3", "8").replace("5", "6")
    assert leak(question, "Here is one. " + changed) == [(1, 16, 16, "template")]
    assert not leak(question, changed.replace("does Anna", "does Olga"))
    assert leak(question, question) == [(1, 16, 16, "verbatim")]


def brute_leaks(docs, items):
    """All alignments of every document and item, window by window, on the words themselves."""
    of = decontaminate.Words()

    def words_of(text):
        literal, kind, named, line, _ = of.of([(text or "").encode()])
        return [tuple(map(int, w)) for w in zip(literal, kind, named, line, strict=True)]

    def forms(window):
        w, plain = len(window), tuple(x[0] for x in window)
        typed, opened = (tuple(x[0] if x[k] == 0 else ("slot", x[k]) for x in window) for k in (1, 2))
        slots = sum(x[1] != 0 for x in window)
        out = {0: plain}
        if 2 * slots <= w:
            if slots:
                out[1] = typed
            if any(x[1] != x[2] for x in window):
                out[2] = opened
        return out

    def run_of(flags):
        best = now = 0
        for f in flags:
            now = now + 1 if f else 0
            best = max(best, now)
        return best

    def consistent(here, kinds, own, doc, shift):
        out, start = [False] * len(own), None
        for k in range(len(own) + 1):
            if k < len(own) and here[k]:
                start = k if start is None else start
            elif start is not None:
                seen = {}
                fine = all(seen.setdefault((own[j][kinds], own[j][0]), doc[j + shift][0]) == doc[j + shift][0] for j in range(start, k) if own[j][kinds])
                out[start:k] = [fine] * (k - start)
                start = None
        return out

    out = set()
    for item_id, question in set(items):
        own = words_of(question)
        n = len(own)
        w = min(8, n)
        for row, text in docs:
            doc = words_of(text)
            if not n:
                continue
            if n < 5:
                by_line = {}
                for x in doc:
                    by_line.setdefault(x[3], []).append(x[0])
                if [x[0] for x in own] in by_line.values():
                    out.add((row, item_id, n, n, "verbatim"))
                continue
            covered, plain = [False] * n, [False] * n
            own_forms, doc_forms = [forms(own[k : k + w]) for k in range(n - w + 1)], [forms(doc[k : k + w]) for k in range(len(doc) - w + 1)]
            for shift in range(-n, len(doc)):
                here, wider = [False] * n, [False] * n
                for there in range(max(0, -shift), min(n - w, len(doc) - w - shift) + 1):
                    a, b = own_forms[there], doc_forms[there + shift]
                    span = range(there, there + w)
                    if a[0] == b[0]:
                        for j in span:
                            here[j] = plain[j] = True
                    for x in (1, 2):
                        for y in (1, 2):
                            if x in a and y in b and a[x] == b[y]:
                                if max(x, y) == 1:
                                    for j in span:
                                        here[j] = True
                                elif 2 * sum((own[j][1] != 0 or own[j][0] != doc[j + shift][0]) and own[j][2] != 0 for j in span) <= w:
                                    for j in span:
                                        wider[j] = True
                found = consistent(here, 1, own, doc, shift)
                if any(wider):
                    found = [x or y for x, y in zip(found, consistent([x or y for x, y in zip(here, wider, strict=True)], 2, own, doc, shift), strict=True)]
                covered = [x or y for x, y in zip(covered, found, strict=True)]
            run = run_of([x or y for x, y in zip(covered, plain, strict=True)])
            if run >= min(13, n):
                out.add((row, item_id, run, n, "verbatim" if run_of(plain) == run else "template"))
    return out


def test_templates_against_brute_force(spark):
    """Questions with some slots exchanged, consistently or not, inside other text, against all alignments."""
    rng = random.Random(21)
    names, verbs = ["Maria", "Tom", "Olga", "Peter", "Ana"], ["buys", "sells", "finds", "moves"]
    shapes = [
        "{a} {v} {x} pens and {y} books at the small shop, then {a} gives {z} pens to {b}. How many pens does {a} have now?",
        "A train from {a} takes {x} hours to reach {b}, while the slow one takes {y} hours; it waits {z} minutes on the way.",
        "{a} {v} {x} kg of rice. {b} {v} {y} kg more than that. Together they carry it home in {z} bags.",
        "{a} has {x}",
        "one {x} and {y} more {v} here",
    ]
    fill = lambda shape, broken=False: shape.format(a=rng.choice(names), b=rng.choice(names), v=rng.choice(verbs), x=rng.randint(2, 9), y=rng.randint(2, 9), z=rng.randint(2, 9)) if not broken else shape.replace("{a}", rng.choice(names), 1).format(a=rng.choice(names), b=rng.choice(names), v=rng.choice(verbs), x=3, y=4, z=5)
    items = [(i, fill(s)) for i, s in enumerate(shapes * 2)] + [(90, "zwei worte"), (91, ""), (92, None)]
    docs = [(100 + i, f"{words(rng, rng.randint(0, 12))}. {fill(rng.choice(shapes), rng.random() < 0.3)} {words(rng, rng.randint(0, 9))}\n{words(rng, 3)}") for i in range(60)]
    docs += [(300, "zwei Worte!\nnoch etwas"), (301, "noch zwei worte hier"), (302, "la " * 60 + "3 la"), (303, fill(shapes[0]) * 2), (304, None), (305, "Tom has 4")]
    items += [(93, "la " * 30), (94, items[0][1])]
    frame = lambda rows, name: spark.createDataFrame(rows, f"{name} long, text string").withColumns({"h": F.lit(1), "row": F.lit("x"), "item": F.lit(2)}).repartition(3)
    got = {tuple(r) for r in decontaminate.find_leaks(frame(docs, "doc_id"), frame(items, "item_id")).collect()}
    want = brute_leaks(docs, items)
    assert got == want and {f for *_, f in want} == {"verbatim", "template"} and len(want) > 20


def test_leaks_against_brute_force(spark, tables):
    """Every document that holds an item's words in a row is found; nothing else in this table."""
    clean = lambda t: [w for w in (x.strip(decontaminate.EDGE).lower() for x in (t or "").encode().split()) if w]
    items = [(r.item_id, b" ".join(clean(r.text))) for r in tables["benchmark"].collect()]
    docs = tables["documents"].where("doc_id < 2500").select("doc_id", "text")
    want = {(r.doc_id, i) for r in docs.collect() for text in [b" " + b" ".join(clean(r.text)) + b" "] for i, t in items if b" " + t + b" " in text}
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, tables["benchmark"]).collect()}
    assert want and got == want


# operator 4


def test_rates_meet_targets(spark, tables):
    table_ = mixing.mix(tables["documents"], tables["labels"]).persist()
    n, p = F.col("n_tokens"), {d: F.col(f"p_{d}") for d in mixing.DOMAINS}
    row = table_.agg(F.sum(n).alias("n"), F.min("rate").alias("low"), *[F.sum(n * x * F.col("rate")).alias(d) for d, x in p.items()]).first()
    assert row.low >= 0 and table_.count() == tables["documents"].count()
    for d, share in mixing.TARGETS.items():
        assert abs(row[d] / row.n - share) < 2e-3


def test_rates_against_numpy(spark):
    rng = np.random.RandomState(2)
    p = rng.dirichlet([0.4, 0.3, 0.3], 300).round(6)
    n = rng.randint(0, 50, 300)
    df = spark.createDataFrame([(i, int(a), *map(float, row)) for i, (a, row) in enumerate(zip(n, p, strict=True))], "doc_id long, n_tokens long, p_clean double, p_toxic double, p_junk double").repartition(3)
    got = {r.doc_id: r.rate for r in mixing.rates(df, {"clean": 0.8, "toxic": 0.15, "junk": 0.05}, steps=60, tolerance=1e-5).collect()}
    rate, wanted = np.ones(300), np.array([0.8, 0.15, 0.05]) * n.sum()
    inverse = np.linalg.inv((p * n[:, None]).T @ p)
    for _ in range(4000):
        rate = np.maximum(0, rate - p @ (inverse @ ((p * (n * rate)[:, None]).sum(0) - wanted)))
    total = (p * (n * np.array([got[i] for i in range(300)]))[:, None]).sum(0)
    assert np.abs(total - wanted).max() < 1e-3 * n.sum()
    assert np.abs(((p * (n * rate)[:, None]).sum(0) - wanted)).max() < 1e-3 * n.sum()


# the pipeline


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({"n_lines": F.lit("x"), "p__": F.lit(1), "kept_text": F.lit(2.5)})
    columns = docs.columns
    before = {r.doc_id: r for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"file://{tmp_path}/{k}"
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        rows = {r.doc_id: r for r in after.collect()}
        assert set(rows) <= set(before) and len(rows) == after.count()
        assert after.columns[: len(columns)] == columns and all(r.n_lines == "x" and r["p__"] == 1 for r in rows.values())
        assert name == "mixing" or after.columns == columns
        if name == "quality":
            junk = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 0").collect()}
            assert not junk & set(rows) and len(rows) >= 0.8 * (len(before) - len(junk))
        elif name == "lines":
            assert all(r.n_chars == len(r.text) for r in rows.values() if r.text != before[r.doc_id].text)
        elif name == "near_duplicates":
            from tests.llm.test_exact import brute_components

            kept = {d for d, _, _, k in brute_components([(d, r.text) for d, r in before.items()], 5, 80) if k}
            assert set(rows) == kept
        elif name == "decontaminate":
            assert len(rows) < len(before)
        elif name == "mixing":
            assert after.columns == [*columns, *mixing.MADE] and set(rows) == set(before)
            assert all(r.text == before[d].text and r.source == before[d].source for d, r in rows.items())
            assert all(int(r.rate) <= r.draws <= int(r.rate) + 1 for r in rows.values())
        before, docs = rows, after
    assert before and all(r.rate >= 0 for r in before.values())


def test_pipeline_on_hard_and_empty_tables(spark, tmp_path):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for name, rows in (("hard", hard_rows()), ("empty", [])):
        folder = f"file://{tmp_path}/{name}"
        table(spark, rows).write.parquet(f"{folder}/documents.parquet")
        (labels if rows else labels.limit(0)).write.parquet(f"{folder}/labels.parquet")
        spark.read.parquet(f"{SF}/benchmark.parquet").limit(5).write.parquet(f"{folder}/benchmark.parquet")
        assert corpus_pipeline.run(spark, folder).count() <= len(rows)


def test_sketches_estimate_similarity():
    """Registers of two sets agree about as often as the sets do, and merge by maximum."""
    rng = np.random.RandomState(8)
    pool = rng.randint(0, 2**63, 1000).astype(np.uint64)
    factors = neardup.multipliers(400)
    sketch = lambda s: neardup.registers_of((s[:, None] * factors).min(0))
    a, b = pool[:900], pool[100:]
    assert abs((sketch(a) == sketch(b)).mean() - 0.8) < 0.07
    assert (np.maximum(sketch(a), sketch(b)) == sketch(pool)).all()
