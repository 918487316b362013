import random
import zlib

import numpy as np
import pytest

from askgrid.llm import language, quality, textcore, toxicity
from tests.llm.conftest import ODD


def test_languages_of_documents(docs):
    model = language.fit(docs)
    rows = language.identify(docs.withColumnRenamed("lang", "known"), model).collect()
    assert np.mean([r.known == r.language for r in rows]) > 0.97


def test_every_language_is_fitted_on_distinct_texts(spark):
    from pyspark.sql import functions as F

    codes = [a + b for a in "abcdefg" for b in "abcdefghij"]
    rows = [(f"word{c} text{c}", c) for c in codes] + [("sample of Chinese", "zh-CN"), ("another one", " ZH_tw "), ("", "12")]
    few = spark.createDataFrame(rows, "text string, lang string")
    model = language.fit(few, rows=2)
    assert set(model.languages) == {*codes, "zh"}
    # Copies take up one place of the sample, wherever their hash sorts.
    texts = spark.createDataFrame([(f"{k} {'abcdefgh'[k] * 3}", "en") for k in range(8)], "text string, lang string")
    first = texts.orderBy(F.xxhash64("text", "lang")).limit(1)
    hot = texts.unionByName(first.crossJoin(spark.range(50)).select("text", "lang"))
    rare = spark.createDataFrame([("zzz", "xx")], "text string, lang string")
    a, b = language.fit(texts.unionByName(rare), rows=8), language.fit(hot.unionByName(rare), rows=8)
    assert a.languages == b.languages == ("en", "xx") and np.array_equal(a.log_share, b.log_share)


def test_labels_that_are_no_codes(spark, docs, monkeypatch):
    from pyspark.sql import functions as F

    names = F.create_map(*[F.lit(x) for x in ("en", " English ", "de", "GERMAN", "fr", "français", "es", "Español (latino)")])
    named = docs.withColumn("lang", names[F.col("lang")])
    codes, model = language.fit(docs), language.fit(named)
    assert model.languages == ("english", "español (latino)", "français", "german")
    order = [codes.languages.index(x) for x in ("en", "es", "fr", "de")]
    assert np.allclose(model.log_share, codes.log_share[order])
    assert language.keep_known(named, model).count() == language.keep_known(docs, codes).count() > 0
    assert language.fit(docs.withColumn("lang", F.lit("und"))).languages == ()
    monkeypatch.setattr(language, "BROADCAST_TEXTS", 0)
    assert np.array_equal(language.fit(docs).log_share, codes.log_share)
    monkeypatch.setattr(language, "MOST_LANGUAGES", 3)
    with pytest.raises(ValueError):
        language.fit(docs)


def unsure_text(model):
    """A text that English and German, of all languages, explain about as well."""
    de, en = model.languages.index("de"), model.languages.index("en")
    gap = lambda t: abs(model.of(t)[de] - model.of(t)[en]) + 3 * max(0, *(x - max(model.of(t)[de], model.of(t)[en]) for x in model.of(t)))
    return min([a + b for a in "aeiounstrdhl" for b in "aeiounstrdhl"], key=gap)


def test_evidence_moves_the_posterior(spark, docs):
    from pyspark.sql import functions as F

    model = language.fit(docs)
    unsure = unsure_text(model)
    frame = spark.createDataFrame([(1, unsure, "a.example.de", "de"), (2, unsure, "b.example.com", "en"), (3, "12 34", "a.example.de", "de"), (4, None, None, None)], "k long, text string, host string, said string")
    plain = {r.k: r.language for r in language.identify(frame, model).collect()}
    told = {r.k: r for r in language.identify(frame, model, host=F.col("host"), declared=F.col("said")).collect()}
    assert plain[1] == plain[2] and told[1].language == "de" and told[2].language == "en"
    assert told[3].language == told[4].language == "und" and not told[3].kept and told[4].posterior == 0


def test_host_priors_are_smoothed_towards_the_domain(spark, docs):
    from pyspark.sql import functions as F

    model = language.fit(docs)
    german = docs.where("lang = 'de'").limit(12).select("text").collect()
    rows = [(10 + i, r.text, f"h{i % 4}.site.org") for i, r in enumerate(german * 20)] + [(1000 + i, r.text, "other.net") for i, r in enumerate(docs.where("lang = 'en'").limit(12).select("text").collect() * 20)]
    rows += [(1, unsure_text(model), "new.site.org"), (2, unsure_text(model), "new.other.net")]
    frame = spark.createDataFrame([(k, t, h) for k, t, h in rows], "k long, text string, host string")
    found = {r.host: r.language for r in language.identify(frame, model, host=F.col("host")).where("host like 'new%'").collect()}
    assert found["new.site.org"] == "de" and found["new.other.net"] != "de"


def test_markup_and_hosts(spark):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([("https://me@www.A.example.de:80/x?y", '<!DOCTYPE html><html class="a" lang="de-AT">'), ("no address", "plain")], "u string, h string")
    a, b = row.select(language.page_host(F.col("u")).alias("u"), language.markup_language(F.col("h")).alias("h")).collect()
    assert tuple(a) == ("a.example.de", "de") and tuple(b) == (None, None)


def test_language_of_odd_and_empty_tables(odd, none):
    model = language.fit(odd)
    for fitted in (model, language.fit(none)):
        found = language.identify(odd, fitted)
        assert found.columns == [*odd.columns, "ag_language", "posterior", "ag_kept"]
        assert found.select(*odd.columns).exceptAll(odd).count() == odd.exceptAll(found.select(*odd.columns)).count() == 0
        assert {r.doc_id for r in found.where("ag_language = 'und'").collect()} >= {3, 4, 5}
    assert found.where("ag_kept").count() == 0
    assert language.identify(none, model).count() == 0
    assert language.keep_known(odd, model).columns == odd.columns


def test_posterior_equals_the_formula_by_hand(spark, docs):
    from pyspark.sql import functions as F

    model = language.fit(docs)
    rows = [(r.doc_id, r.text, f"h{r.doc_id % 3}.site{r.doc_id % 2}.{'de' if r.doc_id % 5 else 'org'}", "de-AT" if r.doc_id % 4 == 0 else None) for r in docs.orderBy("doc_id").limit(60).collect()]
    frame = spark.createDataFrame(rows, "k long, text string, host string, said string")
    got = {r.k: (r.language, round(r.posterior, 9)) for r in language.identify(frame, model, host=F.col("host"), declared=F.col("said")).collect()}
    names, n = model.languages, len(model.languages)
    text = {k: np.array(model.of(t)) for k, t, _, _ in rows if model.of(t)}
    votes, domain = {}, lambda h: ".".join(h.split(".")[-2:])
    for k, _, h, _ in rows:
        if k in text:
            votes.setdefault(h, np.zeros(n))[text[k].argmax()] += 1
    whole = sum(votes.values())
    share = (whole + 1) / (whole.sum() + n)
    for k, _, h, said in rows:
        if k not in text:
            assert got[k] == ("und", 0.0)
            continue
        near = sum(v for x, v in votes.items() if domain(x) == domain(h))
        wide = (near + language.DOMAIN_WEIGHT * share) / (near.sum() + language.DOMAIN_WEIGHT)
        score = text[k] + np.log((votes[h] + language.HOST_WEIGHT * wide) / (votes[h].sum() + language.HOST_WEIGHT))
        if said:
            score += [np.log(language.DECLARED if x == "de" else (1 - language.DECLARED) / (n - 1)) for x in names]
        if h.endswith(".de"):
            score += [np.log(language.SUFFIX if x == "de" else (1 - language.SUFFIX) / (n - 1)) for x in names]
        p = np.exp(score - score.max())
        assert got[k] == (names[score.argmax()], round(1 / p.sum(), 9))


WORDS = [a + b for a in "ba de fi go ku la me no pi ro".split() for b in "ba de fi go ku la me no pi ro".split()]


def toxic_texts(n, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        words = [rnd.choice(WORDS) for _ in range(rnd.randint(20, 300))]
        toxic = i % 3 == 0
        if toxic:
            words[rnd.randrange(len(words))] = "zwixxer" if i % 2 else "glorbnak"
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_toxicity_is_learnt_and_carries_to_misspellings(spark):
    rows = toxic_texts(600, 1)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    found = {r.doc_id: r for r in toxicity.score_documents(docs, model).collect()}
    held = [(found[i].predicted, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i, r in found.items() if r.held_out} == {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([a == b for a, b in held]) > 0.97
    clean = " ".join(WORDS[:60])
    assert toxicity.score(model, clean + " zwixxerr") > toxicity.score(model, clean + " bafigoku")
    assert docs.count() - toxicity.keep_civil(docs, model).count() == sum(r.predicted for r in found.values())


def test_scores_equal_the_layers_by_hand(spark, docs):
    rows = toxic_texts(200, 4)
    frame = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    model = toxicity.fit(frame, labels)
    found = {r.doc_id: r.score for r in toxicity.score_documents(frame, model).collect()}
    for i, text, _ in rows[:50]:
        words, best = text.split(" "), 0.0
        vectors = [np.mean([model.embeddings[b] for b in toxicity.subwords(w)[0]], axis=0) for w in words]
        logits = [np.mean(vectors[a : a + toxicity.SEGMENT], axis=0) @ model.softmax for a in range(0, len(words), toxicity.SEGMENT)]
        best = max(float(z[1] - z[0]) for z in logits)
        assert abs(found[i] - 1 / (1 + np.exp(-(best + model.bias[1] - model.bias[0])))) < 1e-4


def test_labels_that_differ_are_toxic(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)] + [(3, "another text")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, t) for i in range(20) for t in ((0, 1, 1) if i % 2 else (0, 0))], "doc_id long, quality int, toxic int")
    got = sorted(tuple(r) for r in toxicity.training_rows(docs, labels).collect())
    assert got == sorted((i, i % 2, "another text" if i == 3 else f"text {i}") for i in range(20) if zlib.crc32(str(i).encode()) % 5)


def test_held_out_labels_are_never_read(spark):
    rows = toxic_texts(200, 2)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    held = {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    models = [toxicity.fit(docs, spark.createDataFrame([(i, 1 - y if flip and i in held else y) for i, _, y in rows], "doc_id long, toxic int")) for flip in (False, True)]
    assert np.array_equal(models[0].weights, models[1].weights)


def test_toxicity_of_odd_and_empty_tables(spark, odd, none):
    labels = spark.createDataFrame([(1, 0), (2, 1), (2, 1), (7, 0), (None, 1), (8, None)], "doc_id long, toxic int")
    found = toxicity.score_documents(odd, toxicity.fit(odd, labels)).collect()
    assert len(found) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out is not None for r in found)
    unlabelled = toxicity.score_documents(odd, toxicity.fit(odd, labels.limit(0))).collect()
    assert not any(r.predicted for r in unlabelled) and toxicity.score_documents(none, toxicity.fit(none, labels)).count() == 0


def base(text):
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    three = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + j for i, w in enumerate(three) if three.count(w) > 1 for j in range(3)} if len(three) < 3000 else None
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, None if covered is None else len(covered)


def test_base_figures_equal_brute_force(spark, odd, docs):
    both = odd.select("doc_id", "text").unionByName(docs.select("doc_id", "text"))
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    found = quality.judge(both, quality.log_ratios(both, labels)).collect()
    texts = [r.text for r in both.collect()]
    assert len(found) == len(texts)
    wanted = sorted(base(t) for t in texts if base(t)[4] is not None)
    have = [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found]
    assert not set(wanted) - set(have)
    for r in found:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.log_ratio >= quality.THRESHOLD)


def test_ratios_equal_brute_force(spark):
    rows = [(1, "a b c a"), (2, "a b x y"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (None, 1)], "doc_id long, quality int")
    raw, target = np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS)
    for i, t in rows:
        if t:
            own = np.bincount(quality.ngram_buckets(textcore.word_hashes(np.frombuffer(t.encode(), np.uint8))), minlength=quality.BUCKETS)
            raw, target = raw + own, target + own * (i == 1)
    wanted = np.log((target / target.sum() / ((raw + 1) / (raw.sum() + quality.BUCKETS)) + 1) / 2)
    assert np.allclose(quality.log_ratios(docs, labels), wanted)
    assert not quality.log_ratios(docs, labels.limit(0)).any()


def test_quality_labels_that_differ_are_trusted(spark):
    docs = spark.createDataFrame([(1, "a b c a"), (2, "a b x y")], "doc_id long, text string")
    labels = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, quality int")
    both = quality.log_ratios(docs, labels((1, 0), (1, 1), (1, None), (2, 0)))
    assert both.any() and np.array_equal(both, quality.log_ratios(docs, labels((1, 1))))


def test_quality_of_empty_tables(spark, none):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.judge(none, quality.log_ratios(none, labels)).count() == 0


@pytest.mark.parametrize("text", ["", " ", "a", "a b", "\n\na b\x1c c\x0bd", "x" * 70000 + " y"])
def test_words_are_split_at_six_characters_alone(text):
    import re

    body = np.frombuffer(text.encode(), np.uint8)
    starts, ends = textcore.word_spans(body)
    words = [body[a:b].tobytes().decode() for a, b in zip(starts, ends)]
    assert words == re.findall(r"[^\x20\x09-\x0D]+", text)
    hashes = textcore.word_hashes(body)
    assert len(set(hashes.tolist())) == len(set(words)) and len(hashes) == len(words)


def test_quality_scores_equal_the_ratios_by_hand(spark, sf, docs, monkeypatch):
    import re

    labels = spark.read.parquet(f"{sf}/labels.parquet")
    ratios = quality.log_ratios(docs, labels)
    monkeypatch.setattr(quality, "BROADCAST_IDS", 0)
    assert np.array_equal(ratios, quality.log_ratios(docs, labels))
    found = {r.doc_id: r for r in quality.judge(docs, ratios).collect()}
    for r in docs.collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        hashes = [textcore.word_hashes(np.frombuffer(w.encode(), np.uint8)) for w in words]
        grams = [int(h[0]) for h in hashes] + [int(textcore.windows(np.concatenate(p), 2)[0]) for p in zip(hashes, hashes[1:])]
        score = np.mean([ratios[g % quality.BUCKETS] for g in grams]) if grams else 0.0
        own = found[r.doc_id]
        assert own.n_words == len(words) and own.word_chars == sum(map(len, words)) and abs(own.log_ratio - score) < 1e-9
        assert own.kept == (not own.base_failed and own.log_ratio >= quality.THRESHOLD)


def test_ties_of_languages_go_to_the_first_by_name(spark):
    docs = spark.createDataFrame([("abc abd", "yy"), ("abc abd", "xx")], "text string, lang string")
    rows = language.identify(spark.createDataFrame([(1, "abc")], "k long, text string"), language.fit(docs)).collect()
    assert [r.language for r in rows] == ["xx"]
