"""Quality, rules, language, PII and mixing: against plain versions and held-out rows."""

import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from newsloom.llm import language, mixing, pii, quality, queries, rules

SF, SF2 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOC)


def test_quality_on_held_out_rows(spark):
    rows = {r.doc_id: r for r in queries.op1_quality(spark, SF2).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows.values())
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{SF2}/labels.parquet").collect() if rows[r.doc_id].held_out]
    good = [i for i, q in labels if q == 1]
    assert sum(rows[i].predicted == q for i, q in labels) / len(labels) >= 0.9
    assert sum(rows[i].predicted for i in good) / len(good) >= 0.97


def test_quality_of_odd_rows(spark):
    assert quality.train([]).constant == 0.5 and quality.train([("a", 1)]).constant == 1.0
    m = quality.train([("good words in a line", 1), ("%%% *** $$$ ###", 0)] * 10, bits=12)
    d = docs(spark, [(1, None), (None, ""), (2, "good words"), (2, "good words"), (3, "%%% ### " * 20000)]).withColumn("score", F.lit("old"))
    r = quality.score(d, m).collect()
    assert len(r) == 5 and all(0 <= x.score <= 1 for x in r) and [x.held_out for x in r if x.doc_id is None] == [False]
    by = {x.doc_id: x.score for x in r}
    assert by[2] > 0.5 > by[3]
    assert quality.score(d.limit(0), m).count() == 0


def test_scores_do_not_depend_on_neighbours():
    import pyarrow as pa

    m = quality.train([("good words in a line", 1), ("%%% *** $$$ ###", 0)] * 10, bits=12)
    ts = ["good good good", "", "x" * 3000, "%%% a b", None, "é ü"]
    alone = [quality.score_texts(pa.array([t], pa.string()), m)[0] for t in ts]
    assert alone == pytest.approx(list(quality.score_texts(pa.array(ts), m)), rel=1e-5)


def plain_measures(x):
    x = x or ""
    w = re.findall("[^\x20\x09-\x0d]+", x)
    ls = [v for v in x.split("\n") if re.search("[^\x20\x09-\x0d]", v)]
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), len(ls) - len(set(ls)), len(covered)


def test_ledger(spark):
    odd = [None, "", " \t\x0b", "a", "a b c d e a b c d e", "a " * 12, "x\nx\n \nx\n", "#|<> $%&* " * 30, "É" * 40000, "one two three four five six seven eight nine ten"]
    table = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()} | {10**9 + i: t for i, t in enumerate(odd)}
    book = rules.ledger(docs(spark, list(table.items()))).collect()
    assert len(book) == len(table)
    for r in book:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_measures(table[r.doc_id]), repr(table[r.doc_id])[:80]
        assert bool(r.failed & 3) == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
    assert rules.ledger(docs(spark, []).limit(0)).count() == 0


def test_ablations(spark):
    book = spark.createDataFrame([(0,), (1,), (1,), (3,), (4,)], "failed long")
    got = {r.rule: (r.n_failed, r.n_only, r.n_kept, r.n_kept_without) for r in rules.ablations(book, "v2").collect()}
    assert got["few_words"] == (3, 2, 1, 3) and got["repeated_words"] == (1, 0, 1, 1) and got["symbols"] == (1, 1, 1, 2)


def test_language(spark):
    d = spark.read.parquet(f"{SF2}/documents.parquet")
    r = queries.op7_language(spark, SF2).join(d.select("doc_id", "lang"), "doc_id").collect()
    assert len(r) == d.count() and sum(x.language == x.lang for x in r) / len(r) > 0.98 and all(x.kept for x in r)


def test_language_on_held_out_rows(spark):
    """Trained on one half of the rows, measured on the other."""
    d = spark.read.parquet(f"{SF2}/documents.parquet")
    half = F.crc32(F.col("doc_id").cast("string")) % 2
    m = language.fit(d.where(half == 0))
    r = language.identify(d.where(half == 1), m, columns=["doc_id", "lang"]).collect()
    assert len(r) > 400 and sum(x.language == x.lang for x in r) / len(r) > 0.98


def test_op7_equals_plain_bayes(spark):
    """Posteriors by hand from the model, the pages and the hosts' sums."""
    import pyarrow as pa
    from math import exp, log

    d = spark.read.parquet(f"{SF}/documents.parquet")
    m, rows = language.fit(d), d.collect()
    facts = {}
    for f in queries.page_facts(spark.read.parquet(f"{SF}/pages.parquet")).collect():
        facts.setdefault(f.doc_id, []).append(f)
    least = lambda i, c: min((f[c] for f in facts.get(i, []) if f[c] is not None), default=None)
    soft = lambda z: [exp(x - max(z)) / sum(exp(y - max(z)) for y in z) for x in z]
    k, seen, like, host = len(m.languages), {}, {}, {}
    for r in rows:
        l, n, known = language.evidence(pa.array([r.text or ""]), m)
        like[r.doc_id], seen[r.doc_id] = [0.3 * x for x in l[0]], known[0] / n[0] if n[0] else 0.0
        host[r.doc_id] = least(r.doc_id, "host") or r.source
    sums, domains, total = {}, {}, [0.0] * k
    for r in rows:
        if seen[r.doc_id] >= 0.5:
            h = host[r.doc_id]
            for held in (sums.setdefault(h, [0.0] * k), domains.setdefault(".".join((h or "").split(".")[-2:]), [0.0] * k), total):
                for j, x in enumerate(soft(like[r.doc_id])):
                    held[j] += x
    whole = [(t + 1) / (sum(total) + k) for t in total]
    got = {r.doc_id: r for r in queries.op7_language(spark, SF).collect()}
    for r in rows:
        h, dom = host[r.doc_id], domains.get(".".join((host[r.doc_id] or "").split(".")[-2:]))
        z = list(like[r.doc_id])
        if h in sums:
            mid = [(x + 20 * w) / (sum(dom) + 20) for x, w in zip(dom, whole, strict=True)]
            z = [a + log((s + 20 * x) / (sum(sums[h]) + 20)) for a, s, x in zip(z, sums[h], mid, strict=True)]
        z = [a + (2.0 if x == (least(r.doc_id, "declared") or "")[:2].lower() else 0) + (1.0 if x == least(r.doc_id, "suffix") else 0) for a, x in zip(z, m.languages, strict=True)]
        p = soft(z)
        g = got[r.doc_id]
        assert g.language == ("und" if seen[r.doc_id] < 0.5 else m.languages[p.index(max(p))]) and g.confidence == pytest.approx(max(p), rel=1e-6)


def test_suffixes_are_evidence(spark):
    pages = spark.createDataFrame([("https://www.a.fr/x/1", '<html lang="en">'), ("https://b.co.uk/2", ""), ("https://c.com/3", "")], "url string, html string")
    assert {r.doc_id: (r.suffix, r.declared) for r in queries.page_facts(pages).collect()} == {1: ("fr", "en"), 2: ("en", None), 3: (None, None)}


def test_scores_equal_plain_means(spark):
    """A score by hand: the mean of what a text's grams, words and repeated words add."""
    import pyarrow as pa
    from math import exp

    m = quality.train([("good words in a line", 1), ("%%% *** $$$ ###", 0)] * 10, bits=12)
    draw = m.table

    def plain(text):
        ids, n = quality._features(text, 12)
        return 1 / (1 + exp(-sum(float(draw[i]) * int(c) for i, c in zip(ids, n, strict=True)) / int(n.sum())))

    table = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(60).collect()] + ["", "a", "good good good words"]
    assert list(quality.score_texts(pa.array(table), m)) == pytest.approx([plain(t) for t in table], rel=1e-4)


def test_the_sample_is_bounded_in_bytes(spark, monkeypatch):
    given_ = []
    monkeypatch.setattr(quality, "train", lambda rows, **k: given_.append(rows))
    d = docs(spark, [(i, "x" * 100) for i in range(40)])
    labels = d.select("doc_id", (F.col("doc_id") % 2).alias("quality"))
    quality.fit(d, labels, max_bytes=1000)
    assert len(given_[0]) == 10
    quality.fit(d, labels, max_rows=7)
    assert len(given_[1]) == 7


def test_internal_names_as_extra_columns(spark):
    """Every public operator takes columns of any name and gives them back."""
    names = ["_host", "_known", "_like", "_prior", "_of", "_declared", "_p", "_n_host", "_n_p", "_parts", "_base", "_hash", "_part", "_extra", "rid", "copies", "again", "flag", "_found", "_pieces", "_over", "_rid"]
    d = docs(spark, [(i, f"the cat and the dog of the house {i} mail a{i}@b.com") for i in range(12)])
    for n in names:
        d = d.withColumn(n, F.lit("mine"))
    mine = " and ".join(f"`{n}` = 'mine'" for n in names)
    m = language.train([("the cat and the dog of the house", "en"), ("le chat et le chien de la maison", "fr")] * 8, bits=12)
    facts = spark.createDataFrame([(1, "h", "fr", "fr")], "doc_id long, host string, declared string, suffix string")
    for out in (language.identify(d, m, host=F.col("source"), facts_of=facts), mixing.mix(d), pii.replace(d, "k")):
        assert set(names) <= set(out.columns) and out.where(mine).count() == out.count() >= 12
    r = mixing.sized(d)
    out = mixing.mixed(r, mixing.allot(r.select("doc_id", "source", "size")))
    assert out.where(" and ".join(f"`{n}` = 'mine'" for n in names if n != "copies")).count() == 12


def test_every_page_has_its_document(spark):
    for sf in (SF, SF2):
        facts = queries.page_facts(spark.read.parquet(f"{sf}/pages.parquet"))
        assert facts.where("doc_id is null").isEmpty() and facts.join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id", "left_anti").isEmpty()
    odd = spark.createDataFrame([("https://a.de/en/4033.html?x=1", ""), ("https://a.de/77/", ""), ("https://4033.com", ""), ("https://a.de/4033.5", "")], "url string, html string")
    assert [r.doc_id for r in queries.page_facts(odd).collect()] == [4033, 77, None, None]


def test_rare_languages_are_in_the_model(spark):
    d = spark.range(20000).select("id", F.when(F.col("id") % 2000 == 7, "fr").when(F.col("id") == 5, "xx").otherwise("en").alias("lang"))
    d = d.select(F.col("id").alias("doc_id"), F.when(F.col("lang") == "fr", "le chat et le chien de la maison").otherwise("the cat and the dog of the house").alias("text"), "lang")
    assert language.fit(d, bits=12).languages == ["en", "fr"]  # 10 of 20,000 rows; one row is not enough
    assert language.fit(d, max_rows=2, bits=12).languages == ["en", "fr"]
    assert language.fit(d.limit(0)).languages == []


def test_language_evidence_and_odd_rows(spark):
    rows = [("the cat and the dog of the house", "en"), ("le chat et le chien de la maison", "fr")] * 8
    m = language.train(rows, bits=12)
    d = docs(spark, [(1, None), (2, "12 34 !"), (3, "the house of the dog"), (4, "le chien de la maison"), (4, "le chien de la maison"), (5, "日本語日本語日本語")]).withColumn("host", F.lit("x.fr")).withColumn("_host", F.lit(1)).drop("_host")
    r = {x.doc_id: x for x in language.identify(d, m, host=F.col("host")).collect()}
    assert [r[i].language for i in (1, 2, 3, 4, 5)] == ["und", "und", "en", "fr", "und"]
    assert [r[i].kept for i in (1, 2, 3, 4, 5)] == [False, False, True, True, False]
    short = docs(spark, [(1, "the le")])
    conf = lambda **k: language.identify(short, m, **k).first()
    assert conf(declared=F.lit("fr"), suffix=F.lit("fr")).language == "fr" and conf(declared=F.lit("EN-gb")).language == "en"
    assert language.identify(d.limit(0), m).count() == 0
    assert language.identify(d, language.train([])).where("kept").isEmpty()
    facts = spark.createDataFrame([(1, "h", "fr", "fr")], "doc_id long, host string, declared string, suffix string")
    assert language.identify(short, m, facts_of=facts, columns=["doc_id"]).first().language == "fr"


def test_known_rows_are_those_that_identify_keeps(spark):
    m = language.train([("the cat and the dog of the house", "en"), ("le chat et le chien de la maison", "fr")] * 8, bits=12)
    rows = [(1, None, 0), (2, "", 0), (3, "the dog of the cat", 1), (3, "the dog of the cat", 1), (4, "le chien de la maison", 1), (5, "123 456", 0), (None, "the house", 1), (None, "", 0)]
    d = docs(spark, [r[:2] for r in rows]).withColumn("kept", F.lit("mine")).withColumn("rid", F.lit(7))
    facts = spark.createDataFrame([(3, "a.uk", "en", "en"), (3, "b.uk", "en", "en")], "doc_id long, host string, declared string, suffix string")
    for how in ({}, {"host": F.col("source"), "facts_of": facts}):
        got = language.known(d, m, **how)
        assert got.columns == d.columns
        texts = sorted((str(r.doc_id), r.text, r.kept, r.rid) for r in got.collect())
        assert texts == sorted((str(i), t, "mine", 7) for i, t, stays in rows if stays)
        kept = language.identify(d, m, **how).where(F.col("kept"))
        assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == [x[:2] for x in texts]
    assert language.known(d.limit(0), m).count() == 0 and language.known(d, language.train([])).count() == 0


def test_host_priors_lean_on_their_domains(spark):
    h = spark.createDataFrame([("a.x.fr", 0.0, 40.0), ("b.x.fr", 0.0, 0.0), ("c.y.de", 40.0, 0.0), (None, 0.0, 0.0)], "_host string, s0 double, s1 double")
    p = {r._host: r._prior for r in language._priors(h, 2, 20.0).collect()}
    assert p["b.x.fr"][1] > p["b.x.fr"][0] and p["a.x.fr"][1] > p["b.x.fr"][1] and abs(p[None][0] - p[None][1]) < 1e-9


def luhn(s):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(s))) % 10 == 0


def test_pii(spark):
    t1 = "Mail Anna.Bell9@mail5.example.com or anna.bell9@mail5.example.com, +1 (499) 555-6503 and +14995556503; card 4111111111111111 and 4111 1111 1111 1111."
    t2 = 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" ip 152.143.123.131. Mrs. Maria Lopez met Mr. Carlo Rossi. Call +1 (499) 555-6503'
    rows = [(1, t1), (2, t2), (3, None), (4, ""), (5, "clean text of 12 words, 2024 and 3.14"), (2, t2)]
    r = pii.replace(docs(spark, rows), "key")
    assert r.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_entities"]
    out = r.collect()
    by = {x.doc_id: x.text for x in out}
    assert len(out) == 6 and by[3] is None and by[4] == "" and by[5] == rows[4][1]
    for secret in ("Bell9", "bell9@", "555-6503", "4995556503", "4111111111111111", "24be64439e", "152.143.123.131", "Lopez", "Carlo"):
        assert secret not in by[1] + by[2]
    mails = re.findall(r"[\w.]+@[\w.]+\.com", by[1])
    assert len(mails) == 2 and mails[0].lower() == mails[1] and mails[0][0].isupper()
    phone = re.findall(r"\+1 \(\d{3}\) \d{3}-\d{4}", by[1] + by[2])
    assert len(phone) == 2 and phone[0] == phone[1] and re.sub(r"\D", "", phone[0]) in re.sub(r"[^\d+]", " ", by[1]).replace("+", "").split()
    cards = re.findall(r"\b4\d{15}\b", by[1])
    assert len(cards) == 1 and luhn(cards[0]) and " ".join(re.findall("....", cards[0])) in by[1]
    assert all(0 <= int(o) < 256 for o in re.search(r"ip (\d+\.\d+\.\d+\.\d+)", by[2])[1].split("."))
    names = re.search(r"Mrs\. (\w+) (\w+) met Mr\. (\w+) (\w+)\.", by[2])
    assert names and names[1] in pii.GIVEN["female, Latin"] and names[3] in pii.GIVEN["male, Latin"] and [names[i][-1] for i in (2, 4)] == ["z", "i"] and all(n[0].isupper() for n in names.groups())
    assert pii.replace(docs(spark, rows), "key").where("doc_id = 1").first().text == by[1] != pii.replace(docs(spark, rows), "other").where("doc_id = 1").first().text
    assert pii.replace(docs(spark, []).limit(0), "key").count() == 0


def test_secrets_in_capitals_and_long_ones(spark):
    upper, mixed = "9233A8EC" * 5, "9233a8EC" * 5
    rows = [(1, f'TOKEN = "{upper}"'), (2, f"see {upper} and {mixed} end"), (3, "Password: Hunter2hunter2"), (4, "token = " + "Ab3x" * 250 + " end"), (5, "x " + "0a1b2c3d" * 200 + " end"), (6, "SECRET: QWERTYXY_ZZ9"), (7, "GHP_" + "A1B2C3" * 6)]
    by = {r.doc_id: r for r in pii.replace(docs(spark, rows), "key").collect()}
    assert [by[i].n_entities for i in range(1, 8)] == [1, 2, 1, 1, 1, 1, 1]
    for secret in ("9233A8EC", "9233a8EC", "Hunter2", "Ab3x" * 3, "0a1b2c3d", "QWERTY", "A1B2C3"):
        assert not any(secret in r.text for r in by.values())
    one = re.fullmatch(r'TOKEN = "([0-9A-F]{40})"', by[1].text)[1]
    assert re.fullmatch(r"see ([0-9A-F]{40}) and [0-9]{4}[a-f][0-9][A-F]{2}.* end", by[2].text)[1] == one
    assert re.fullmatch(r"token = [A-Za-z0-9]{1000} end", by[4].text) and re.fullmatch(r"x [0-9a-f]{1600} end", by[5].text)


def given(first, moved):
    out = {(r.kind, r.canonical): r.surrogate for r in first.collect()}
    return out | ({} if moved is None else {(r.kind, r.canonical): r.surrogate for r in moved.collect()})


def test_surrogates_are_distinct_and_not_real(spark):
    """Small formats, chains of real values that lead into one another, and formats in which every value is real."""
    draw = lambda kind, values: {r.c: r.s for r in spark.createDataFrame([(kind, v) for v in values], "kind string, c string").select("c", F.expr(pii.permute_sql("key", "kind", "c")).alias("s")).collect()}
    chain = ["anna@mail.com"]
    for _ in range(3):  # the surrogate of each is the next
        chain.append(draw("email", chain[-1:])[chain[-1]])
    values = [("email", v) for v in chain] + [("email", f"{c}@b.co") for c in "bcdfghjklm"] + [("name", f"{c}o") for c in "BCDFGHJKLMNPQRSTVWXZ"] + [("ssn", f"{7 * i:09d}") for i in range(256)] + [("phone", f"{7 * i:09d}") for i in range(100, 300)]
    real = spark.createDataFrame(values, "kind string, canonical string")
    got = given(*pii.surrogates(real, "key"))
    assert set(got) == set(values) and len(set(got.values())) == len(values) and not set(got.values()) & {v for _, v in values}
    text = docs(spark, [(i, f"write to {c} now") for i, c in enumerate([*chain, "ewku@myar.com"])])
    out = [r.text.split()[2] for r in pii.replace(text, "key").collect()]
    assert len(set(out)) == len(set(chain) | {"ewku@myar.com"}) and not set(out) & {*chain, "ewku@myar.com"}
    assert pii.collisions(text, "key").isEmpty()


def test_a_full_format_raises(spark, monkeypatch):
    """Rather than keep a real value."""
    monkeypatch.setattr(pii, "ATTEMPTS", 3)
    monkeypatch.setattr(pii, "_attempt", lambda key, n: "canonical")
    with pytest.raises(ValueError, match="no free surrogate"):
        pii.surrogates(spark.createDataFrame([("ssn", "111223333")], "kind string, canonical string"), "k")


def test_names_keep_gender_script_and_family(spark):
    rows = [(1, "Mrs. Maria Lopez met Carlos Garcia Ruiz and Mr. Lopez."), (2, "Ольга Петрова и Иван Петров"), (3, "Anna alone, Maria too"), (4, "then Maria Lopez came"), (5, "Mrs. Xulia Lopez")]
    by = {r.doc_id: r for r in pii.replace(docs(spark, rows), "key").collect()}
    assert [by[i].n_entities for i in range(1, 6)] == [3, 2, 0, 1, 1] and by[3].text == rows[2][1]
    m = re.fullmatch(r"Mrs\. (\w+) (\w+) met (\w+) (\w+) (\w+) and Mr\. (\w+)\.", by[1].text)
    assert m and m[1] in pii.GIVEN["female, Latin"] and m[3] in pii.GIVEN["male, Latin"] and m[2] == m[6] != "Lopez" and m[1] != "Maria"
    assert by[4].text == f"then {m[1]} {m[2]} came" and by[5].text.endswith(f" {m[2]}")
    f = re.fullmatch(r"(\w+) (\w+) и (\w+) (\w+)", by[2].text)
    assert f and f[1] in pii.GIVEN["female, Cyrillic"] and f[3] in pii.GIVEN["male, Cyrillic"] and f[2].endswith("а") and f[4].endswith("в") and all(x > "А" for x in f.groups())


def test_given_names_that_map_onto_each_other(spark):
    """With every listed name real, no surrogate is one of them; the audit sees given names."""
    listed = [n for names in pii.GIVEN.values() for n in names]
    text = docs(spark, [(i, f"then {n} Quorzz came") for i, n in enumerate(listed)] + [(900, "Mrs. Anna"), (901, "Mrs. Marie"), (902, "Mrs. Sophie")])
    by = {r.doc_id: r.text for r in pii.replace(text, "k").collect()}
    new = [by[i].split()[1] for i in range(len(listed))]
    assert len(set(new)) == len(listed) and not set(new) & set(listed)
    for old, n in zip(listed, new, strict=True):
        of = next(names for names in pii.GIVEN.values() if old in names)
        assert len(n.split("-")) > 1 and set(n.split("-")) <= set(of)
    assert {by[i].split()[1] for i in (900, 901, 902)} == {new[listed.index(n)] for n in ("Anna", "Marie", "Sophie")}
    assert pii.collisions(text, "k").isEmpty()
    few = docs(spark, [(1, "Mrs. Anna"), (2, "Mrs. Marie"), (3, "Mrs. Sophie")])
    for key in "kabcdefg":
        got = {r.text.split()[1] for r in pii.replace(few, key).collect()}
        assert len(got) == 3 and not got & {"Anna", "Marie", "Sophie"}
    ring = lambda key: [pii._given_sql(key, 0)]  # noqa: E731  one known pair says nothing of the others
    assert ring("a") != ring("b")


def test_parts_of_names(spark):
    rows = [(1, "Mrs. María Pérez-García spoke"), (2, "Jean-Pierre Martin spoke"), (3, "Dr. O'Brien and Dr. Müller's team"), (4, "ANNA LOPEZ and Anna Lopez"), (5, "Mr. Bruno Keller, Mr. Keller"), (6, "Frau Xenia von der Heide-Braun"), (7, "MRS. LOPEZ"), (8, "Mr. Bruno"), (9, "Anna-Maria Lopez")]
    by = {r.doc_id: r.text for r in pii.replace(docs(spark, rows), "k").collect()}
    whole = " ".join(by.values())
    for part in ("María", "Pérez", "García", "Jean", "Pierre", "Martin", "Brien", "Müller", "ANNA", "LOPEZ", "Anna", "Lopez", "Bruno", "Keller", "Xenia", "Heide", "Braun"):
        assert not re.search(rf"(?<![^\W_]){part}(?![^\W_])", whole), part
    assert re.fullmatch(r"Mrs\. \w+ \w+z-\w+a spoke", by[1])
    male = "|".join(pii.GIVEN["male, Latin"])
    assert re.fullmatch(rf"((?:{male})-?)+ \w+n spoke", by[2])
    assert re.fullmatch(r"Dr\. O'\w+n and Dr\. \w+r's team", by[3])
    capitals, plain = by[4].split(" and ")
    assert capitals == plain.upper() and by[7] == f"MRS. {capitals.split()[1]}"
    m = re.fullmatch(rf"Mr\. ((?:{male})(?:-(?:{male}))*) (\w+r), Mr\. (\w+)", by[5])
    assert m and m[2] == m[3]
    female = "|".join(pii.GIVEN["female, Latin"])
    assert re.fullmatch(rf"Frau (?:{female})(?:-(?:{female}))* von der \w+e-\w+n", by[6])
    assert pii.collisions(docs(spark, rows), "k").isEmpty()
    clean = [(1, "The DRUM and Dr. in the hall; MISS THE BUS, rock'n'roll, Anna alone, it's Marie's")]
    assert pii.replace(docs(spark, clean), "k").first().text == clean[0][1]


def test_numbers_are_no_cards(spark):
    rows = [(1, "order 4111111111111112 and card 4111111111111111 12"), (2, "9807915762804490"), (3, "token = 4111111111111112"), (4, "Password: Hunterhunter")]
    by = {r.doc_id: r for r in pii.replace(docs(spark, rows), "key").collect()}
    assert by[1].n_entities == 1 and "4111111111111112" in by[1].text and "4111111111111111" not in by[1].text
    assert by[2].text == rows[1][1] and by[2].n_entities == 0
    assert by[3].n_entities == by[4].n_entities == 1 and "4111111111111112" not in by[3].text and "Hunter" not in by[4].text


def test_op9_equals_a_plain_rewriting(spark):
    """The table's values found by plain patterns, and put through one dictionary."""
    d = spark.read.parquet(f"{SF2}/documents.parquet")
    first, moved = pii.surrogates(pii.entities(d), "a key of the release")
    table, before = given(first, moved), {r.doc_id: r.text for r in d.collect()}
    assert len(set(table.values())) == len(table) > 50 and not set(table.values()) & {c for _, c in table}
    kinds = {"email": r"[\w.]+@[\w.]+\.com", "secret": r"(?<=token = \")[0-9a-fA-F]{40}", "ip": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.])", "phone": r"\+1 \(\d{3}\) \d{3}-\d{4}", "card": r"(?<![\d.])\d{16}(?!\d)"}
    find = re.compile("|".join(f"(?P<{k}>{v})" for k, v in kinds.items()), re.I)

    def put(m):
        e, kind = m[0], m.lastgroup
        if kind == "card" and not luhn(e):
            return e
        kind = ("hex" if e.lower() == e else "HEX") if kind == "secret" else kind
        s = table[kind, e.lower() if kind == "email" else re.sub(r"\D", "", e) if kind in ("phone", "card") else e]
        if kind == "phone":
            digits = iter(s)
            return re.sub(r"\d", lambda _: next(digits), e)
        return "".join(b.upper() if a.isupper() else b for a, b in zip(e, s, strict=True)) if kind == "email" else s

    for r in queries.op9_pii(spark, SF2).collect():
        assert r.text == find.sub(put, before[r.doc_id])


def test_private_values_are_gone(spark):
    d = spark.read.parquet(f"{SF2}/documents.parquet")
    before = {r.doc_id: r.text for r in d.collect()}
    find = re.compile(r"\S+@\S+\.com|\+1 \(\d{3}\) \d{3}-\d{4}|\b\d+\.\d+\.\d+\.\d+\b|[0-9a-f]{40}")
    for r in queries.op9_pii(spark, SF2).collect():
        found = find.findall(before[r.doc_id])
        assert (r.text != before[r.doc_id]) == bool(r.n_entities) and bool(found) <= bool(r.n_entities)
        assert not any(x in r.text for x in found)


def plain_targets(sizes):
    """By the words of the contract: share, stop at twice, reshare."""
    names = sorted((k for k in sizes if k is not None)) + [None] * (None in sizes)
    w = {k: (5, 2, 1)[i % 3] for i, k in enumerate(names)}
    t, left, open_ = {}, 1.5 * sum(sizes.values()), set(names)
    while open_:
        level = left / sum(w[k] for k in open_)
        full = {k for k in open_ if w[k] * level > 2 * sizes[k]}
        if not full:
            return t | {k: w[k] * level for k in open_}
        for k in full:
            t[k] = 2.0 * sizes[k]
            left -= t[k]
        open_ -= full
    return t


def test_mix(spark):
    rows = queries.op10_mixing(spark, SF2).collect()
    words = {r.doc_id: (len(re.findall("[^\x20\x09-\x0d]+", r.text)), r.source) for r in spark.read.parquet(f"{SF2}/documents.parquet").collect()}
    sizes, taken, goal = Counter(), Counter(), {}
    for r in rows:
        n, s = words[r.doc_id]
        assert r.size == n and r.taken in (0, n, 2 * n)
        sizes[s] += n
        taken[s] += r.taken
        goal[s] = r.target
    assert goal == pytest.approx(plain_targets(sizes), rel=1e-9) and {r.source_size for r in rows} == set(sizes.values())
    assert all(abs(taken[s] - goal[s]) <= 0.01 * goal[s] for s in goal)
    again = {(r.doc_id, r.taken) for r in queries.op10_mixing(spark, SF2).collect()}
    assert again == {(r.doc_id, r.taken) for r in rows}


def test_mix_of_odd_rows(spark):
    d = spark.createDataFrame([(i, "w " * (1 + i % 3), s) for i in range(600) for s in ("a", None)] + [(-1, None, "a"), (-2, "", "empty")] + [(7, "w w", "c")] * 3000, "doc_id long, text string, source string").withColumn("target", F.lit("old"))
    rows = mixing.sized(d)
    out = mixing.mixed(rows, mixing.allot(rows.select("doc_id", "source", "size"), part=100)).collect()
    assert len(out) == 1200 + 2 + 3000
    taken, sizes, goal = Counter(), Counter(), {}
    for r in out:
        taken[r.source] += r.taken
        sizes[r.source] += r.size
        goal[r.source] = r.target
        assert 0 <= r.copies <= 2
    want = plain_targets(sizes)
    assert goal == pytest.approx(want) and all(abs(taken[s] - want[s]) <= 3 for s in want)
    assert mixing.mix(d.limit(0)).count() == 0
    m = mixing.mix(d)
    assert m.columns == d.drop("target").columns + ["target"] and m.where("doc_id < 0").count() == 2
