"""The operators on small tables with NULLs, ties, repeated rows, empty and long texts, against plain versions."""

import hashlib
import random
import re
import tracemalloc
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablewright.llm import repeats, sharding, tables
from tablewright.llm.decontamination import clean_documents, matches
from tablewright.llm.extraction import main_text
from tablewright.llm.mixing import apply_mix, mix_documents
from tablewright.llm.near_duplicates import deduplicated, first_of_each
from tablewright.llm.quality_rules import filter_documents
from tablewright.llm.queries import QUERIES, SQL
from tablewright.llm.repeats import without_repeats
from tablewright.llm.rule_ensemble import good_documents, score_documents
from tablewright.llm.secret_scan import scan_documents
from tablewright.llm.sharding import shard_documents
from tablewright.llm.suffixes import suffix_order
from tablewright.llm.warc import archive_pages, page_records, read_warc, write_warc
from tablewright.runtime import scratch_path, small_batches

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, _row string, place int"
RNG = random.Random(1)
VOCABULARY = ["".join(RNG.choice("abcdefghijklmnop") for _ in range(RNG.randrange(2, 9))) for _ in range(400)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(VOCABULARY) + ("." if rng.random() < 0.1 else "") for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    base = prose(120)
    words = base.split()
    near = [" ".join(words[:k] + ["changed"] + words[k + 1:]) for k in (5, 40, 80)]
    texts = [base, base, *near, "", None, " \n\t ", "one two", "one two", prose(4000), *[prose(RNG.randrange(5, 90)) for _ in range(20)]]
    out = [(k, t, "en", f"s{k % 3}" if k % 7 else None, 0, "x", 1) for k, t in enumerate(texts)]
    return [*out, out[3], out[3], (None, base, None, None, None, None, None), (None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([], "doc_id bigint, quality int, toxic int")


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_mix(docs, none, rows):
    out = mix_documents(docs).collect()
    assert len(out) == len(rows) and mix_documents(none).count() == 0
    assert sorted(r["size"] for r in out) == sorted(len(_words(r[1])) for r in rows)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in out)
    largest = Counter()
    taken, target, size = Counter(), {}, {}
    source = {(r[0], len(_words(r[1]))): r[3] for r in rows}
    for r in out:
        s = source[r["doc_id"], r["size"]]
        taken[s] += r["taken"]
        largest[s] = max(largest[s], r["size"] * sum(x[0] == r["doc_id"] for x in rows))
        target[s], size[s] = r["target"], r["source_size"]
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6 and target[s] <= 2 * size[s] for s in target)
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-6
    assert sorted(map(tuple, out), key=repr) == sorted(map(tuple, mix_documents(docs.repartition(5)).collect()), key=repr)
    mixed = apply_mix(docs)
    assert mixed.columns == docs.columns and sum(len(_words(r["text"])) for r in mixed.collect()) == sum(taken.values())


def test_shards(docs, none, rows):
    out = shard_documents(docs).collect()
    assert len(out) == len(rows) and shard_documents(none).count() == 0
    for shard in range(8):
        slots = sorted(r["slot"] for r in out if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert sum(r["size"] for r in out) == sum(len((r[1] or "").encode()) + 1 for r in rows)


def test_shards_need_few_broadcasts(docs, monkeypatch, capsys):
    """Every broadcast stays with the driver for long: one a round of a cut and one for the slots, however many scans there are."""
    plans = []

    def shown(df):
        df.explain()
        plans.append(capsys.readouterr().out)
        return df

    for module in (sharding, tables):
        monkeypatch.setattr(module, "stored", lambda df, name="step", write=module.stored: write(shown(df), name))
    shown(shard_documents(docs)).collect()
    rounds = sum("Window" in p and "place" in p for p in plans)
    assert 3 <= rounds <= 3 * 4
    assert sum(p.count("BroadcastExchange") for p in plans) <= rounds + 1


def test_shards_are_even(spark):
    same = spark.range(4000).selectExpr("id AS doc_id", "repeat('x', CAST(50 + id % 40 AS int)) AS text", "IF(id % 3 = 0, 'hot', CAST(id % 50 AS string)) AS source", "CAST(NULL AS string) AS lang")
    sums = [r["n"] for r in shard_documents(same).groupBy("shard").agg(F.sum("size").alias("n")).collect()]
    assert len(sums) == 8 and max(sums) < 1.03 * min(sums)


@pytest.fixture(scope="module")
def pages(spark):
    body = "<p>" + "long text " * 150 + "</p>"
    return spark.createDataFrame([(1, "http://a", body), (2, "http://b\r\nx: y", body), (3, None, body), (3, None, body), (4, "u", "short"), (5, "u", "short"), (6, "u", None),
                                  (7, "u", ""), (None, "u", body)], "page_id bigint, url string, html string")


def test_archives(spark, pages):
    out = {(r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in archive_pages(pages).collect()}
    size = len("<p>" + "long text " * 150 + "</p>")
    assert out == {(1, "revisit", 3, size), (2, "revisit", 3, size), (3, "response", None, size), (4, "response", None, 5), (5, "response", None, 5),
                   (6, "response", None, 0), (7, "response", None, 0), (None, "revisit", 3, size)}
    assert archive_pages(pages).count() == 9 and archive_pages(pages.limit(0)).count() == 0


def test_every_split_of_an_archive_gives_each_record_once(spark, pages):
    many = pages.select(F.explode(F.sequence(F.lit(1), F.lit(20))).alias("k"), "url", "html").selectExpr("k * 10 AS page_id", "url", "concat(html, k) AS html")
    files = write_warc(page_records(many).repartition(2), scratch_path(spark, "warc"))
    whole = sorted(read_warc(files).select("record_id", "payload_digest").collect())
    assert len(whole) == 180
    for size in (97, 1000):
        assert sorted(read_warc(files, size).select("record_id", "payload_digest").collect()) == whole


def test_damaged_members_are_passed_over(spark, pages, tmp_path):
    files = write_warc(page_records(pages).coalesce(1), str(tmp_path))
    path = files.first()["path"]
    data = bytearray(open(path, "rb").read())
    data[30:40] = b"\x00" * 10
    open(path, "wb").write(bytes(data))
    assert read_warc(files, 50).count() == 8


def test_main_text():
    page = ('<html><body><header>Top</header><nav><a href="#">Menu</a></nav><div class="cookie-notice">We use cookies</div><div id="wrap"><h1>Head &amp; line</h1>'
            '<p>First <b>bold</b>text of the article that goes on for a while.<p>Second   paragraph,\nwhich is long as well and has no links.<br>x</p></div>'
            '<div class="comments"><p>A reader says a lot of things about this article here.</p></div><form>mail</form><footer>(c)</footer>')
    assert main_text(page) == "Head & line First boldtext of the article that goes on for a while. Second paragraph, which is long as well and has no links. x"
    assert [main_text(t) for t in (None, "", "<nav>x</nav>", "plain", '<script>var a="</p>";</script>')] == ["", "", "", "plain", ""]
    assert main_text("<article><h1>A</h1><p>b</p>" + "<p>word word</p>" * 20000).endswith("word word")


def test_main_text_keeps_paragraphs_around_the_densest():
    long, other = "words of the first paragraph that go on and on " * 20, "another part of the same article without links " * 3
    for start, end in (("<article>", "</article>"), ("<main>", "</main>"), ("<div>", "</div>"), ("<div><div>", "</div></div>")):
        page = f"<body><nav>x</nav>{start}<h1>Head</h1><p><b>{long}<br><p>{other}</p><p>{other}</p><p>{other}</p><p>Short end.</p>{end}<footer>y</footer>"
        assert main_text(page) == " ".join(f"Head {long} {other} {other} {other} Short end.".split())
    links = "<ul>" + '<li><a href="/">Somewhere else on this site</a></li>' * 8 + "</ul>"
    page = f"<body>{links}<p>Short start.</p><div><p>{other}</p><p>{long}</p><p>{other}</p></div>{links}"
    assert main_text(page) == " ".join(f"Short start. {other} {long} {other}".split())


def _base(text):
    w = _words(text)
    windows = {}
    for k in range(len(w) - 4):
        windows.setdefault(tuple(w[k:k + 5]), []).append(k)
    covered = {j for starts in windows.values() if len(starts) > 1 for s in starts for j in range(s, s + 5)}
    lines = [line for line in (text or "").split("\n") if _words(line)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_base_counts(spark, labels):
    texts = [None, "", "a b c d e a b c d e f", "x\nx\ny \n\nx", "### é*é |", "t " * 30, "a b c d e f g", "q r s t u v q r s t u q r s t u"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in filter_documents(df, labels).collect():
        assert tuple(r)[1:6] == _base(texts[r["doc_id"]])
    assert filter_documents(df.limit(0), labels).count() == 0


@pytest.fixture(scope="module")
def judged(spark):
    rng = random.Random(8)
    made = [(k, prose(rng.randrange(30, 120), rng) if k % 5 else " ".join(w + "!!" for w in prose(60, rng).upper().split()), k % 5 > 0) for k in range(600)]
    df = spark.createDataFrame(made, "doc_id bigint, text string, good boolean")
    return df, df.selectExpr("doc_id", "CAST(good AS int) AS quality")


def test_rules_find_what_labels_mark(judged):
    df, labels = judged
    out = filter_documents(df, labels).join(df, "doc_id")
    assert out.where("kept <> good AND NOT base_failed").count() == 0 and out.where("rule = 1").count() > 0


def test_ensemble_on_held_out_rows(spark, judged, labels):
    df, marks = judged
    out = score_documents(df, marks).join(df, "doc_id").where("held_out")
    assert out.count() > 100 and out.where("(predicted = 1) <> good").count() <= 0.02 * out.count()
    extra = df.unionByName(spark.createDataFrame([(None, None, None), (9999, "", None)], df.schema))
    assert score_documents(extra, labels).where("score BETWEEN 0 AND 1").count() == 602
    assert good_documents(df.withColumn("_text", F.lit(1)), marks).columns == [*df.columns, "_text"]


def _components(rows, per_cent):
    sets = []
    for r in rows:
        w = [re.sub(r"[A-Z]", lambda m: m[0].lower(), x) for x in _words(r[1])]
        sets.append({tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(rows)))
    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= per_cent * len(sets[a] | sets[b]):
            x, y = label[a], label[b]
            label = [min(x, y) if v in (x, y) else v for v in label]
    least = {}
    for r, v in zip(rows, label):
        least[v] = min(least.get(v, float("inf")), r[0] if r[0] is not None else float("inf"))
    return sorted((repr(r[0]), len(s), repr(None if least[v] == float("inf") else least[v])) for r, s, v in zip(rows, sets, label))


def test_near_duplicates(docs, none, rows):
    out = deduplicated(docs)
    assert sorted((repr(r["doc_id"]), r["n_shingles"], repr(r["component_id"])) for r in out.collect()) == _components(rows, 85)
    assert deduplicated(none).count() == 0
    kept = first_of_each(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect() if r["text"] and r["text"].startswith(rows[0][1][:20])} == {0}
    assert kept.where("text IS NULL OR trim(text) = ''").count() == 3 and kept.where("text = 'one two'").count() == 1


def test_a_large_group_of_near_copies(spark):
    rng = random.Random(2)
    base = prose(80, rng).split()
    made = []
    for k in range(400):
        w = list(base)
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(VOCABULARY)
        made.append((k, " ".join(w)))
    out = deduplicated(spark.createDataFrame(made, "doc_id bigint, text string")).collect()
    assert sorted((repr(r["doc_id"]), r["n_shingles"], repr(r["component_id"])) for r in out) == _components(made, 85)


def _removed(texts, length):
    data = [(t or "").encode() for t in texts]
    counts = Counter(b[k:k + length] for b in data for k in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = {j for k in range(len(b) - length + 1) if counts[b[k:k + length]] > 1 for j in range(k, k + length)}
        rest = bytes(c for j, c in enumerate(b) if j not in gone)
        out.append((len(b), len(gone), sum(j - 1 not in gone for j in gone), hashlib.sha256(rest).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("length", [20, 60])
def test_repeated_strings(spark, docs, none, rows, length):
    texts = [r[1] for r in rows] + ["the " * 40, "é" * 70, prose(30) + rows[0][1][100:300], "short"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string").repartition(4)
    out = without_repeats(df, length)
    assert sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out.collect()) == _removed(texts, length)
    assert without_repeats(none, length).count() == 0 and without_repeats(docs, length).count() == len(rows)


def test_a_passage_in_many_documents_is_no_large_shard(spark, monkeypatch):
    rng, sizes, sort = random.Random(3), [], repeats.shard_repeats
    passage = prose(15, rng)
    texts = [f"{prose(8, rng)} {passage} {prose(8, rng)}" for _ in range(300)] + ["a" * 5000, prose(100, rng)]

    def watched(pieces, length):
        sizes.extend(r["n"] for r in pieces.groupBy("shard").agg(F.sum(F.length("piece")).alias("n")).collect())
        return sort(pieces, length)

    monkeypatch.setattr(repeats, "SHARD_BYTES", 3000)
    monkeypatch.setattr(repeats, "shard_repeats", watched)
    out = without_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4), 60)
    assert sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out.collect()) == _removed(texts, 60)
    assert max(sizes, default=0) <= 12_000


def _peak_mb(work):
    tracemalloc.start()
    work()
    peak = tracemalloc.get_traced_memory()[1] / (1 << 20)
    tracemalloc.stop()
    return peak


class _Worker:
    """Hands out the function that a step runs in its tasks."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run


def test_a_task_of_repeated_strings_holds_little():
    rng = random.Random(8)
    texts = [prose(400, rng) for _ in range(900)]
    batch = pa.record_batch([pa.array([b"%d" % k for k in range(len(texts))]), pa.array(texts)], names=["name", "text"])
    assert batch.nbytes > 2 << 20
    assert _peak_mb(lambda: sum(b.num_rows for b in repeats.stretches(_Worker(), 400)(iter([batch])))) < 40
    base = np.frombuffer("".join(texts)[:1 << 20].encode(), np.uint8)
    assert len(base) == 1 << 20 and _peak_mb(lambda: suffix_order(base, 400)) < 110


def test_long_rows_go_to_workers_in_small_batches(spark):
    df = spark.range(600).repartition(1).selectExpr("id", "repeat('long text ', 2000) AS text")
    rows = lambda: df.mapInArrow(lambda batches: (pa.record_batch([pa.array([b.num_rows])], names=["n"]) for b in batches), "n bigint").agg(F.max("n")).first()[0]
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    with small_batches(spark):
        assert rows() < 300
    assert spark.conf.get(name, None) == before and rows() == 600


def test_benchmark_passages(spark, docs, none, rows):
    item = prose(40)
    w = item.split()
    edited = " ".join(w[:10] + ["other"] + w[11:25] + w[26:])
    extra = [(100, f"{prose(50)} {item.upper()} {prose(20)}"), (101, f"{prose(20)} {edited} {prose(9)}"), (102, f"{prose(9)} {' '.join(w[:20])} {prose(30)}"), (None, item)]
    texts = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id bigint, text string"))
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, prose(30)), (None, item)], "item_id bigint, text string")
    found = {(r["doc_id"], r["item_id"], r["edits"]) for r in matches(texts, bench).collect()}
    assert found == {(d, i, e) for d, e in ((100, 0), (101, 2), (None, 0)) for i in (1, None)}
    clean = clean_documents(texts, bench)
    assert clean.count() == texts.count() - 3 and clean.columns == texts.columns
    assert matches(none, bench).count() == 0 and matches(texts, bench.limit(0)).count() == 0


def test_secrets(spark):
    rng = random.Random(5)
    text = lambda k, s: f"{prose(20, rng)} {s} {prose(10, rng)}"
    key = lambda: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))
    digits = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(18)) + "1"
    made = [(k, text(k, ("AKIA" + key(), "password=" + digits(), f'token = "{digits()}"###', "internationalisation", "4111111111111111", "sha1 " + digits())[k % 6]), "a/b") for k in range(240)]
    df = spark.createDataFrame([*made, (None, None, None), (999, "", None)], "doc_id bigint, text string, source string")
    found = {r["doc_id"] for r in scan_documents(df).collect()}
    assert found == {k for k in range(240) if k % 6 < 3}
    assert scan_documents(df.limit(0)).count() == 0


def test_secrets_inside_words(spark):
    rng = random.Random(9)
    key = lambda p, n: p + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(n)) + "2B7"
    forms = ("api_key={a},region=eu", '{{"api_key":"{a}","user":"bob"}}', "https://host.org/?key={a}&x=1", "one={a};aws_secret_access_key_2={b}", '{{"k":["{a}","{b}"],"a_long_plain_name":"internationalisation"}}',
             'password="{a}"', "longer_password={a}==", "{a}:{b}", "internationalisation,4111111111111111,characteristically")
    made, secrets = [], {}
    for k in range(270):
        form, a, b = forms[k % 9], key("AKIA", 16), key("ghp_", 30)
        made.append((k, f"{prose(20, rng)} {form.format(a=a, b=b)} {prose(10, rng)}", "a/b"))
        secrets[k] = {s + "==" * ("}==" in form) for s, mark in ((a, "{a}"), (b, "{b}")) if mark in form}
    found = scan_documents(spark.createDataFrame(made, "doc_id bigint, text string, source string")).collect()
    assert {(r["doc_id"], r["token_sha256"]) for r in found} == {(k, hashlib.sha256(s.encode()).hexdigest()) for k, own in secrets.items() for s in own}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for table in ("documents", "pages", "labels", "benchmark"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df, expected = QUERIES[name](spark, sf_dir), duck.sql(SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(expected.columns)
    found = [dict(zip(expected.columns, r)) for r in expected.fetchall()]
    assert sorted(repr([r[c] for c in columns]) for r in df.collect()) == sorted(repr([r[c] for c in columns]) for r in found)
