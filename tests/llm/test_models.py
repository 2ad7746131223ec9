"""Language, quality, toxicity and personal data: held-out accuracy, brute force and defined edge cases."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import language_id, pii, quality, queries, toxicity
from loomgraph.llm.common import bounded_sample, labelled_sample
from tests.llm.cases import ROWS, empty, table

MEDIUM = "/root/testdata/sf0.01"
PIECE = public_tokenizers.path("piece_bpe_32k.model")


def joined(spark, name, sf, column):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = queries.queries()[name](spark, sf)
    return got.join(docs, "doc_id").join(labels, "doc_id", "left").select(*got.columns, "lang", F.col("quality"), "toxic").toPandas()


# ---- language


def segmentations(word):
    for cuts in itertools.product((False, True), repeat=len(word) - 1):
        parts, at = [], 0
        for i, cut in enumerate(cuts, start=1):
            if cut:
                parts.append(word[at:i])
                at = i
        yield [*parts, word[at:]]


def test_forward_sums_all_segmentations():
    vocabulary = language_id.load_vocabulary(PIECE)
    r = np.random.default_rng(1)
    prob = r.random((vocabulary.size + 1, 2)) * 0.01
    prob[-1] = 0
    model = language_id.LanguageModel(PIECE, ["a", "b"], np.zeros(2), prob)
    words = ["▁the", "▁nation", "▁ñandú", "▁z日q", "▁"]
    got = model.word_scores(words)

    def probability(part):
        (piece,) = [int(x[0, 0]) for x in [vocabulary.lattice(language_id._codes([part]))[-1]]] if len(part) <= language_id.LONGEST_PIECE else [vocabulary.size]
        if len(part) == 1:
            return np.maximum(prob[piece], model.floor)
        return prob[piece]

    for word in words:
        total = sum(np.prod([probability(p) for p in parts], axis=0) for parts in segmentations(word))
        assert np.allclose(np.exp(got[word]), total)


def exact_log_probability(word, prob_of):
    """By fractions, prefix by prefix."""
    alpha = [Fraction(1)]
    for j in range(1, len(word) + 1):
        alpha.append(sum(alpha[i] * prob_of(word[i:j]) for i in range(max(0, j - language_id.LONGEST_PIECE), j)))
    return math.log(alpha[-1].numerator) - math.log(alpha[-1].denominator)


def test_long_words_are_scored_whole():
    vocabulary = language_id.load_vocabulary(PIECE)
    r = np.random.default_rng(2)
    prob = r.random((vocabulary.size + 1, 2)) * 0.001
    prob[-1] = 0
    model = language_id.LanguageModel(PIECE, ["a", "b"], np.zeros(2), prob)
    letters = random.Random(3)
    words = ["▁" + "".join(letters.choice("aeinorstlñ日") for _ in range(n)) for n in (15, 16, 17, 39, 60, 200)] + ["▁" + "q" * 90]
    got = model.word_scores(words)
    for word in words:
        for k in (0, 1):

            def prob_of(part, k=k):
                piece = int(vocabulary.lattice(language_id._codes([part]))[-1][0, 0])
                p = float(prob[piece, k])
                return Fraction(max(p, model.floor) if len(part) == 1 else p)

            assert got[word][k] == pytest.approx(exact_log_probability(word, prob_of), rel=1e-9)
        ((alpha, scale),) = list(language_id._forward(vocabulary, language_id._codes([word]), prob, model.floor, at_once=5))[-1:]
        assert np.allclose(np.log(alpha[0]) + scale[0], got[word])
    assert language_id.words_of("x" * 500) == ["▁" + "x" * 500]


def test_expected_uses_are_those_over_all_segmentations():
    vocabulary = language_id.load_vocabulary(PIECE)
    prob = np.random.default_rng(4).random((vocabulary.size + 1, 1)) * 0.01
    prob[-1] = 0
    word, floor = "▁international日s", 1e-7
    found = np.zeros(vocabulary.size + 1)
    language_id._expect(vocabulary, language_id._codes([word]), prob, floor, np.array([3.0]), found)
    uses, total = Counter(), 0.0
    pieces = {(i, j): int(vocabulary.lattice(language_id._codes([word[i:j]]))[-1][0, 0]) for i in range(len(word)) for j in range(i + 1, min(i + 16, len(word)) + 1)}
    for parts in segmentations(word):
        at, p, met = 0, 1.0, []
        for part in parts:
            piece = pieces.get((at, at + len(part)), vocabulary.size)
            p *= max(prob[piece, 0], floor) if len(part) == 1 else prob[piece, 0]
            met.append(piece)
            at += len(part)
            if not p:
                break
        if p:
            total += p
            for piece in met:
                uses[piece] += p
    for piece, p in uses.items():
        assert found[piece] == pytest.approx(3 * p / total)


@pytest.mark.parametrize("hot", [7, 8, 9])
def test_a_language_whose_rows_share_an_id_is_learned(spark, hot):
    rows = [(i, f"the quick brown fox number {'a' * (i % 7)}", "en") for i in range(300)] + [(hot, f"der schnelle Fuchs und {'b' * (i % 9)}", "de") for i in range(4000)]
    rows += [(9, None, "fr")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    assert model.languages == (["de", "en"] if hot != language_id_held_out(spark) else ["en"])
    if "de" in model.languages:
        got = language_id.identify(spark.createDataFrame([(1, "und der Fuchs")], "doc_id long, text string"), model).head()
        assert got.lang_pred == "de"


def language_id_held_out(spark):
    """Of the ids 7, 8 and 9 the one, if any, that is held out."""
    import zlib

    return next((i for i in (7, 8, 9) if zlib.crc32(str(i).encode()) % 4 == 2), None)


def test_too_many_languages_are_an_error(spark):
    docs = spark.createDataFrame([(i, "word", f"l{i}") for i in range(40)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="more than 20 values"):
        language_id.fit(docs, most_languages=20)


def test_samples_are_bounded_and_never_empty(spark):
    rows = [(1, "hot")] * 3000 + [(i, f"text {i}") for i in range(500)]
    df = spark.createDataFrame(rows, "id long, text string")
    assert {tuple(r) for r in bounded_sample(df, 1000, ["text"]).collect()} == set(rows)
    few = bounded_sample(df, 20, ["text"]).collect()
    assert len(few) == 20 == len(set(few)) and set(map(tuple, few)) <= set(rows)
    assert [tuple(r) for r in bounded_sample(df.filter("text = 'hot'"), 20, ["text"]).collect()] == [(1, "hot")]
    by = bounded_sample(df.withColumn("odd", F.col("id") % 2), 30, ["text"], "odd").groupBy("odd").count().collect()
    assert {r["odd"]: r["count"] for r in by} == {0: 30, 1: 30}
    assert bounded_sample(df.limit(0), 20, ["text"]).count() == bounded_sample(df.limit(0), 20, ["text"], "id").count() == 0


def test_a_labelled_id_on_many_rows_stays_bounded(spark):
    docs = spark.createDataFrame([(1, f"text {i % 2000}") for i in range(6000)] + [(8, "other")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in (1, 8)], "doc_id long, quality int, toxic int")
    found = labelled_sample(docs, labels, "quality", 100).collect()
    assert Counter(r.label for r in found) == {1: 100, 0: 1} and len({r.text for r in found}) == 101


def test_vocabulary_finds_pieces_and_nothing_else():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    usable = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    pieces = sorted(p for p in usable if p == p.lower() and len(p) <= language_id.LONGEST_PIECE)
    vocabulary = language_id.load_vocabulary(PIECE)
    for i in range(0, len(pieces), 97):
        assert vocabulary.lattice(language_id._codes([pieces[i]]))[-1][0, 0] == i
    assert vocabulary.lattice(language_id._codes(["qqxzj"]))[-1][0, 0] == vocabulary.size


def test_language_accuracy(spark):
    rows = joined(spark, "op1_language_id", MEDIUM, "lang")
    assert len(rows) == 1000
    held = rows[rows.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.99
    assert rows.score.between(0, 1).all()


def test_language_edges(spark):
    docs = table(spark)
    model = language_id.fit(docs)
    rows = language_id.identify(docs, model).collect()
    assert len(rows) == len(ROWS)
    by_id = {r.doc_id: r for r in rows}
    for doc_id in (2, 3, 7, 10):
        assert (by_id[doc_id].lang_pred, by_id[doc_id].score) == ("und", 0.0)
    assert by_id[None].held_out is True
    assert by_id[1].lang_pred in model.languages
    kept = language_id.keep_identified(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, None, 5, 6, 8, 9}
    untrained = language_id.fit(empty(spark))
    assert untrained.languages == []
    assert {r.lang_pred for r in language_id.identify(docs, untrained).collect()} == {"und"}
    assert language_id.identify(empty(spark), model).count() == 0


# ---- quality


def test_quality_accuracy(spark):
    rows = joined(spark, "op2_quality_classifier", MEDIUM, "quality")
    held = rows[rows.held_out & rows.quality.notna()]
    assert (held.predicted == held.quality).mean() > 0.97
    assert rows.score.between(0, 1).all() and ((rows.score >= 0.7).astype(int) == rows.predicted).all()


def test_discriminant_is_the_posterior():
    r = np.random.default_rng(2)
    x = [r.normal(0, 1, (50, 3)), r.normal(1, 2, (80, 3))]
    model = quality.discriminant([len(a) for a in x], [a.sum(0) for a in x], [a.T @ a for a in x], shrink=0.2)
    both = np.vstack(x)
    pooled = np.diag(both.var(0))

    def density(a, point):
        covariance = 0.8 * np.cov(a.T, bias=True) + 0.2 * pooled
        d = point - a.mean(0)
        return math.exp(-0.5 * d @ np.linalg.solve(covariance, d)) / math.sqrt(np.linalg.det(covariance)) * len(a) / len(both)

    for point in both[::17]:
        p0, p1 = (density(a, point) for a in x)
        assert model.score(point[None])[0] == pytest.approx(p1 / (p0 + p1))


def test_statistics_of_parts_are_those_of_the_whole():
    text = " ".join(random.Random(1).choice(["Ab", "cd!", "ef|", "ab ab", "x\ny"]) for _ in range(500))
    whole = quality.statistics(text)
    assert quality.statistics(text, part_chars=64) == pytest.approx(whole)


def test_quality_edges(spark):
    docs = table(spark)
    labels = spark.createDataFrame([(1, 1, 0), (5, 1, None), (6, 0, 1), (8, 0, 0), (9, None, 1), (10, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    rows = quality.score(docs, model).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    one_class = quality.fit(docs, labels.filter("quality = 1"))
    assert {r.score for r in quality.score(docs, one_class).collect()} == {0.5}
    assert quality.score(empty(spark), model).count() == 0
    assert quality.keep_good(docs, model).columns == docs.columns


# ---- toxicity


def test_machines_compose_as_they_run():
    r = random.Random(3)
    negation, target = toxicity._countdown("n", 3, toxicity.NEGATED), toxicity._countdown("t", 4, toxicity.DIRECTED)
    both = negation.compose(target)
    for _ in range(300):
        clause = "".join(r.choice("123htno") for _ in range(r.randint(0, 12)))
        between, first = negation.run(clause)
        written, second = target.run(between)
        assert both.run(clause) == (written, pytest.approx(first + second))


@pytest.mark.parametrize(
    ("clause", "written"),
    [("ot1", "ota"), ("ono1", "ono4"), ("nooo1", "nooo1"), ("ro2", "ro8"), ("hot", "hoH"), ("noht", "nokt"), ("rht", "rpt"), ("h", "h"), ("rno1", "rno7")],
)
def test_grammar(clause, written):
    assert toxicity.grammar().run(clause)[0] == written


def test_toxicity_accuracy(spark):
    rows = joined(spark, "op3_toxicity_grammar", "/root/testdata/sf0.1", "toxic")
    held = rows[rows.held_out & rows.toxic.notna()]
    assert held[held.toxic == 1].predicted.mean() > 0.9
    assert held[held.toxic == 0].predicted.mean() < 0.02
    assert rows.score.between(0, 1).all()


def test_toxicity_learns_from_all_distinct_texts(spark):
    rows = [(i, f"shared words everywhere and one own {'insult' if i % 4 == 0 else 'word'} w{i // 2 * 2}", i % 4 == 0) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(x)) for i, _, x in rows], "doc_id long, quality int, toxic int")
    sample = toxicity.labelled_sample(docs, labels, "toxic", 4000, "doc_id", "text")
    want = {(r.label, r.text) for r in sample.collect()}
    assert toxicity.fit(docs, labels).trained_on == tuple(sum(x == label for x, _ in want) for label in (0, 1))


def plain_evidence(text, insults):
    """Clause by clause, through the five machines one after the other."""
    fixed = {w: s for words, s in ((toxicity.THREATS, "h"), (toxicity.TARGETS, "t"), (toxicity.NEGATIONS, "n"), (toxicity.REPORTS, "r")) for w in words}
    clauses, words = [[]], (text or "").split()
    for token in words:
        word = re.sub(r"^\W+|\W+$", "", token.lower())
        grades = [insults[f"={word}"]] if insults.get(f"={word}") else [insults[word[:k]] for k in range(3, min(len(word), 8) + 1) if word[:k] in insults]
        clauses[-1].append(max(grades) if grades else fixed.get(word, "o"))
        if token[-1] in ".,;:!?|":
            clauses.append([])
    events, added, matched = Counter(), 0.0, 0
    for clause in clauses:
        if not {"1", "2", "3", "h"} & set(clause):
            continue
        matched += 1
        out, negated, reported = [], 0, False
        for s in clause:  # negations reach three symbols, reported speech to the clause's end
            if s == "n":
                negated = 4
            now = {"1": "4", "2": "5", "3": "6", "h": "k"}.get(s, s) if negated else s
            negated = max(0, negated - 1)
            if reported:
                now = {**dict(zip("123456", "789789", strict=True)), "h": "p", "k": "p"}.get(now, now)
            reported = reported or now == "r"
            out.append(now)
        threat, final = 0, []
        for s in out:  # a threat and, up to four symbols later, its target
            if s == "h":
                threat, weight = 5, 1.0
            elif s == "t" and threat:
                s, threat, weight = "H", 0, 2.0
            else:
                weight = 0.0
            added += weight
            threat = max(0, threat - 1)
            final.append(s)
        aimed = 0
        for s in final:  # an insult up to four symbols behind a target
            if s == "t":
                aimed = 5
            elif aimed and s in "123":
                s = "abc"["123".index(s)]
            aimed = max(0, aimed - 1)
            for marks, share in (("123", 1.0), ("456", 0.25), ("789", 0.25), ("abc", 1.5)):
                if s in marks:
                    added += (1.0, 2.0, 4.0)[marks.index(s)] * share
            if s in "123456789abchkpH":
                events[s] += 1
    weak, strong = sum(events[e] for e in "147a"), sum(events[e] for e in "235689bcH")
    counts = [math.log1p(x) for x in (*(events[e] for e in "123456789abchkpH"), added, matched)]
    return [*counts, float(weak >= 2), float(weak >= 3), *(math.log1p(1000 * x / max(len(words), 1)) for x in (weak, strong))]


def rude(r, n):
    words = ["you", "idiot", "scum", "not", "said", "kill", "them", "fine", "tree", "u", "moron!", "so,", "no", "hurt", "ok.", "your\n", "fool\t", "nasty"]
    return " ".join(r.choice(words) for _ in range(n))


def test_evidence_matches_a_plain_scorer_for_any_size_of_parts():
    insults = {f"={w}": "2" for w in toxicity.INSULTS} | {"nas": "1", "scu": "3"}
    reader, r = toxicity.Reader(insults), random.Random(6)
    texts = [rude(r, r.randint(0, 60)) for _ in range(400)] + [None, "", "you " * 50 + "idiot", "idiot"]
    for text in texts:
        want = plain_evidence(text, insults)
        for part_chars in (1, 7, 50, 1 << 20):
            assert reader.evidence(text, part_chars).tolist() == pytest.approx(want)


def test_a_clause_is_not_lost_where_a_very_long_text_is_cut():
    reader = toxicity.Reader({f"={w}": "2" for w in toxicity.INSULTS})
    for size in range((1 << 20) - 12, (1 << 20) + 4):
        text = "x" * (size - 1) + " you idiot"
        assert reader.evidence(text)[toxicity.EVENTS.index("b")] > 0


def test_scores_of_a_table_match_the_plain_scorer(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in toxicity.score(docs, model).collect():
        x = np.array(plain_evidence(texts[r.doc_id], model.insults), float) @ model.weights[:-1] + model.weights[-1]
        assert r.score == pytest.approx(1 / (1 + math.exp(-max(min(x, 30), -30))))


def test_toxicity_edges(spark):
    docs = table(spark)
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (9, None, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == len(ROWS) and len({r.score for r in rows}) == 1 and rows[0].matched_clauses == 0
    unlabelled = toxicity.fit(docs, labels.filter("toxic = 5"))
    insults = spark.createDataFrame([(1, "You idiot."), (2, "Nobody minds.")], "doc_id long, text string")
    scored = {r.doc_id: r for r in toxicity.score(insults, unlabelled).collect()}
    assert scored[1].predicted == 1 and scored[2].predicted == 0
    assert toxicity.score(empty(spark), model).count() == 0


# ---- personal data

PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def plain_luhn(digits):
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def plain_spans(text):
    found = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = [True, all(int(p) <= 255 for p in m.group().split(".")) if kind == 1 else True, 13 <= len(digits) <= 19 and plain_luhn(digits) if kind == 2 else True, 9 <= len(digits) <= 15]
            if good[kind]:
                found.append((kind, m.start(), m.end()))
    return found


def test_base_spans_are_the_patterns():
    r = random.Random(3)
    for _ in range(20_000):
        text = "".join(r.choice("aB1290.@.-+ ()%é") for _ in range(r.randint(0, 40)))
        assert pii.base_spans(text) == plain_spans(text)
    for text in ("a" * 3000 + "@b.c", "1." * 3000, "9" * 30_000, "+1 " * 2000, "x@" * 2000 + "y.z"):
        assert pii.base_spans(text) == plain_spans(text)


def test_windows_cover_what_can_be_in_a_span():
    r = random.Random(5)
    for _ in range(500):
        text = "".join(r.choice("ab 1@." if r.random() < 0.3 else "abc ") for _ in range(r.randint(0, 400)))
        cut = list(pii.windows(text))
        assert all(b - a <= pii.WINDOW for a, b in cut)
        for i, c in enumerate(text):
            if c in "1@":
                assert any(a <= i < b for a, b in cut)


def test_gradients():
    examples = pii.made_examples(40)
    tagger = pii.Tagger.new(hidden=4)
    tagger.p = {k: v.astype(float) for k, v in tagger.p.items()}
    codes, lengths = pii.symbols([t[:15] for t, _ in examples[:5]])
    tags = np.random.default_rng(0).integers(0, pii.TAGS, codes.shape)
    _, grads = tagger.loss_gradient(codes, lengths, tags)
    for name, g in grads.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        values = []
        for step in (1e-3, -2e-3):
            tagger.p[name][at] += step
            values.append(tagger.loss_gradient(codes, lengths, tags)[0])
        tagger.p[name][at] += 1e-3
        assert g[at] == pytest.approx((values[0] - values[1]) / 2e-3, rel=1e-2, abs=1e-4)


def test_viterbi_is_the_best_path():
    r = np.random.default_rng(4)
    tagger = pii.Tagger.new(hidden=3)
    tagger.p["trans"] = r.normal(0, 1, (pii.TAGS, pii.TAGS)).astype(np.float32)
    e = r.normal(0, 1, (4, 1, pii.TAGS)).astype(np.float32)
    got = tagger._viterbi(e, np.ones((1, 4), bool))[0].tolist()

    def score(tags):
        if any(t > 0 and t % 2 == 0 and (i == 0 or tags[i - 1] not in (t - 1, t)) for i, t in enumerate(tags)):
            return -np.inf
        return sum(e[i, 0, t] for i, t in enumerate(tags)) + sum(tagger.p["trans"][a, b] for a, b in itertools.pairwise(tags))

    assert score(got) == pytest.approx(max(map(score, itertools.product(range(pii.TAGS), repeat=4))), abs=1e-4)


@pytest.fixture(scope="module")
def tagger():
    return pii.train(pii.made_examples())


def test_tagger_on_held_out_examples(tagger):
    held = pii.made_examples(300, seed=99)
    decoded = tagger.decode([t for t, _ in held])
    exact = [sorted((k, a, b) for k, a, b, _ in found) == sorted(spans) for found, (_, spans) in zip(decoded, held, strict=True)]
    assert np.mean(exact) > 0.85


def test_model_adds_and_base_stays(tagger):
    beside = "to +1 (269) 555-3296 4532015112830366 today"  # the phone's pattern takes the card's digits too
    ((own, added),) = pii.find_spans([beside], tagger)
    assert own == [] and sorted(added) == [(2, 21, 37), (3, 3, 20)]
    texts = ["Call (017) 555-7713 now", "mail to bob@mail.example.com or 10.1.2.3", "version 4.0. of 2024-01-15", ""]
    (_, added), (own, _), (none, clean), (nothing, _) = pii.find_spans(texts, tagger)
    assert added == [(3, 5, 19)]
    assert own == plain_spans(texts[1])
    assert none == clean == nothing == []
    assert pii.hide(texts[1], own) == "mail to [EMAIL] or [IP]"


def test_personal_data_edges(spark, tagger):
    docs = table(spark)
    rows = pii.personal_data(docs, tagger).collect()
    assert len(rows) == len(ROWS)
    empty_digest = hashlib.sha256(b"").hexdigest()
    assert {r.base_sha256 for r in rows if r.doc_id in (1, 2, 3, 5, 6, 7)} == {empty_digest}
    kept = pii.hidden(docs, tagger)
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect())[(2, None)] == 1
    assert pii.personal_data(empty(spark), tagger).count() == 0


@pytest.mark.parametrize("before", ["", "see ", "1 2 3 4 5 6 7 8 9 " * 60, "x" * 30 + " "])
@pytest.mark.parametrize("address", ["johannsen.mueller@müller-bau.de", "a@" + "müller" * 20 + ".de", "l" * 64 + "@" + "ü" * 186 + ".de"])
def test_long_addresses_lie_whole_in_a_window(before, address):
    text = f"{before}{address} and more"
    start, end = len(before), len(before) + len(address)
    found = [(a, b) for a, b in pii.windows(text) if a <= max(0, start - pii.CONTEXT) and b >= min(len(text), end + pii.CONTEXT)]
    assert found and all(b - a <= pii.WINDOW for a, b in pii.windows(text))


def test_every_admissible_span_lies_whole_in_a_window():
    """All spans that could pass, found by trying all starts and ends."""
    r, met = random.Random(8), Counter()
    for _ in range(300):
        text = "".join(r.choice(("1", "12", "555", "a", "ü", ".", "-", "(", " ", "     ", "@", "x" * 40, "+", "@m.de", "9.9")) for _ in range(r.randint(1, 40)))
        cut = list(pii.windows(text))
        for start in range(len(text)):
            for end in range(start + 3, min(len(text), start + 90) + 1):
                for kind in range(4):
                    if pii._plausible(kind, text, (start, end)):
                        met[kind] += 1
                        low, high = max(0, start - pii.CONTEXT), min(len(text), end + pii.CONTEXT)
                        assert any(a <= low and high <= b for a, b in cut)
    assert all(met[k] for k in (0, 1, 3))


def plain_reconciled(text, tagger):
    """Windows one by one; of windows that hold a span the one farthest from whose edges it is; then the best spans first."""
    base, spans = plain_spans(text), {}
    for a, b in pii.windows(text):
        ((*found,),) = tagger.decode([text[a:b]])
        for kind, start, end, sure in found:
            left, right = start if a > 0 else 10**6, b - a - end if b < len(text) else 10**6
            room = min(left, right, pii.WINDOW)
            if room > spans.get((kind, a + start, a + end), (-1, 0))[0]:
                spans[kind, a + start, a + end] = (room, sure)
    added = []
    for kind, start, end in sorted(spans, key=lambda x: (-spans[x][0], -spans[x][1], x)):
        free = all(end <= s[1] or start >= s[2] for s in base + added)
        if free and spans[kind, start, end][1] >= pii.LEAST[kind] and pii._plausible(kind, text, (start, end)):
            added.append((kind, start, end))
    return base, sorted(added)


def test_windows_are_reconciled_over_the_whole_text(tagger):
    r, more = random.Random(9), 0
    for seed in range(12):
        parts = [t for t, _ in pii.made_examples(30, seed=seed)]
        text = "".join(p + r.choice((" ", "\n", "", " and then there was a longer stretch of text without any numbers at all ")) for p in parts)
        ((own, added),) = pii.find_spans([text], tagger)
        want_base, want_added = plain_reconciled(text, tagger)
        assert (own, sorted(added)) == (want_base, want_added)
        more += len(added)
    assert more > 20


def test_long_address_that_only_the_model_finds(tagger):
    for address in ("johannsen.mueller@müller.com", "johannsen.mueller@müller-bau.de"):
        ((_, added),) = pii.find_spans([f"mail to {address} now"], tagger)
        assert added == [(0, 8, 8 + len(address))]


def test_personal_data_query(spark, small):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = queries.op9_personal_data(spark, small).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = plain_spans(docs[r.doc_id])
        text = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in want) for k in range(4))
        assert set(text.split(",")) <= set(r.spans.split(",")) or not want
