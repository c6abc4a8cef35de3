import random
import re

from pyspark.sql import functions as F

from tenderspark.llm import licenses as li


def cut(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def shingles(w):
    return {tuple(w[i : i + li.WIDTH]) for i in range(len(w) - li.WIDTH + 1)}


def brute(docs, templates):
    """{(doc, license): best containment over all places}."""
    out = {}
    for d, text in docs:
        w = cut(text)
        for name, t in templates.items():
            x = cut(t)
            wanted = shingles(x)
            best = max((len(wanted & shingles(w[max(0, s - 4) : s + len(x) + 4])) / len(wanted) for s in range(-len(x), len(w) + 1)), default=0)
            if best >= li.CONTAINED and d is not None:
                out[d, name] = max(best, out.get((d, name), 0))
    return out


def test_against_brute_force(spark):
    r = random.Random(3)
    noise = [f"n{k}" for k in range(50)] + ["license", "under", "the"]
    docs = []
    for i in range(150):
        w = [r.choice(noise) for _ in range(r.choice([0, 4, 40]))]
        if r.random() < 0.8:
            x = r.choice(list(li.TEMPLATES.values())).split()
            if len(x) > 20:
                for _ in range(r.choice([0, 1, 2])):
                    x[r.randrange(len(x))] = "changed"
            at = r.randint(0, len(w))
            w[at:at] = x
        docs.append((i, " ".join(w)))
    docs += [(900, None), (901, ""), (None, li.TEMPLATES["gpl"]), (902, "MIT License"), (903, "w " * 30_000 + li.TEMPLATES["mit"]), (903, "w " * 30_000 + li.TEMPLATES["mit"])]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, license string, near int")
    rows = li.scan_licenses(df).collect()
    expected = brute(docs, li.TEMPLATES)
    assert len(expected) > 100
    got = {(r.doc_id, r.license): r.containment for r in rows}
    assert len(rows) == len(got)
    assert {k: round(v, 9) for k, v in got.items()} == {k: round(v, 9) for k, v in expected.items()}
    place = {(r.doc_id, r.license): r.first_word for r in rows}
    assert place[903, "mit"] == 30_000
    assert li.scan_licenses(df.limit(0)).count() == 0


def test_own_templates_and_native_plan(spark):
    df = spark.createDataFrame([(1, "all rights of this text are kept by us")], "doc_id long, text string")
    found = li.scan_licenses(df, {"own": "rights of this text are kept", "short": "of this"})
    assert [tuple(r) for r in found.collect()] == [(1, "own", 1, 1.0)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_recall_of_one_shingle_in_a_window(spark):
    """Windows of four random shingles, the first of which is a template's: the share with it as a minimum in some band."""
    n = 20_000
    hashes = spark.range(n).select(F.array(*(F.xxhash64("id", F.lit(k)) for k in range(li.STRIDE))).alias("s"))
    both = hashes.select(li._minima(F.col("s"), F.lit(0), li.STRIDE).alias("window"), li._minima(F.col("s"), F.lit(0), 1).alias("template"))
    assert both.where(F.arrays_overlap("window", "template")).count() > 0.995 * n


def test_each_one_line_notice_is_found(spark):
    r = random.Random(5)
    lines = {k: t for k, t in li.TEMPLATES.items() if len(cut(t)) < 14}
    docs = []
    for i in range(400):
        name = r.choice(list(lines))
        noise = [f"x{r.randrange(10**6)}" for _ in range(40)]
        at = r.randrange(40)
        docs.append((i, " ".join([*noise[:at], lines[name], *noise[at:]]), name))
    found = {(x.doc_id, x.license) for x in li.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string, name string")).collect()}
    assert sum((i, name) in found for i, _, name in docs) >= 0.99 * len(docs)


def test_bands_of_documents_are_compiled(spark):
    """Of a window only its shingles are laid out in a lambda, which Spark interprets; equal to the minima of a lambda, at a text's end too."""
    texts = [(n, " ".join(f"w{n * 7 + k}" for k in range(n))) for n in range(30)] + [(99, li.TEMPLATES["mit"])]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    table = spark.createDataFrame([("own", texts[23][1]), ("mit", li.TEMPLATES["mit"])], "license string, text string")
    found = li.find_candidates(docs, table)
    assert re.search(r"Generate explode\(array\(least\(", found._jdf.queryExecution().optimizedPlan().toString())

    s = docs.select("doc_id", li._shingles(li.words(F.col("text"))).alias("s")).where("s IS NOT NULL")
    places = F.sequence(F.lit(0), F.size("s") - 1, F.lit(li.STRIDE))
    windows = s.select("doc_id", F.posexplode(F.transform(places, lambda i: li._minima(F.col("s"), i, li.STRIDE))).alias("w", "v")).select("doc_id", "w", F.explode("v").alias("value"))

    def run(n):
        t = table.select("license", li._shingles(li.words(F.col("text"))).alias("s"))
        v = F.transform(F.sequence(F.lit(0), F.size("s") - n), lambda i: li._minima(F.col("s"), i, n))
        return t.select("license", F.posexplode(v).alias("at", "v")).select("license", "at", F.explode("v").alias("value"))

    runs = [run(n) for n in range(1, li.STRIDE + 1)]
    bands = runs[0].union(runs[1]).union(runs[2]).union(runs[3])
    want = {(r.doc_id, r.license, r.w * li.STRIDE - r.at) for r in windows.join(bands, "value").collect()}
    assert len(want) > 20
    assert {tuple(r) for r in found.collect()} == want
