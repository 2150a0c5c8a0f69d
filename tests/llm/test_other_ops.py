"""URL filters, nearest neighbours, PII, HTML, language and toxicity."""

import itertools
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pointweave.llm import url_filter
from pointweave.llm.ann import nearest_neighbours, quantised, tile_product
from pointweave.llm.html_extract import Chain as HtmlChain
from pointweave.llm.html_extract import block_features, extract_main_text, labelled_pages, leaf_blocks, main_text, trained_chain
from pointweave.llm.langid import (
    CELL,
    PRIOR_STRENGTH,
    declared_language,
    identify_languages,
    train_text_model,
    visible_text,
)
from pointweave.llm.pii import (
    LABELS,
    SemiMarkov,
    _sentences,
    base_spans,
    find_personal_data,
    find_spans,
    luhn,
    regions,
    segment_features,
    trained_field,
)
from pointweave.llm.queries import URL_RULES
from pointweave.llm.toxicity import FOLDS, Chain, Vocabulary, _fit, _odds, features_of, fit_chain, score_toxicity, train_chain
from pointweave.llm.url_filter import filter_urls, rules_frame

# -- URL filters ------------------------------------------------------------------


def plain_verdict(url, rules):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(len(h + p), v == "block", h + p, v) for v, h, p in rules if path.startswith(p) and host and (host == h or host.endswith("." + h))]
    if not fits:
        return host, path, None, "allow"
    best = min(fits, key=lambda x: (-x[0], not x[1], x[2]))
    return host, path, best[2], best[3]


@pytest.mark.parametrize("broadcast", [True, False])
def test_url_filter(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(url_filter, "MAX_BROADCAST_RULES", 0)
    rng = random.Random(1)
    hosts = ["example.com", "WWW.Example.com", "a.b.net", "net", "com", "xcom", "", "example.com:80", "a..net", "é.net"]
    paths = ["", "/", "/en/", "/en", "/english/x", "/es/1?x=/fr/", "/fr/#top", "?q=/en/", "/EN/", "/en/a\n/b"]
    urls = [f"{rng.choice(['http', 'https', ''])}://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(200)]
    urls += [None, "", "no scheme", "a://b://c/en/", urls[0], urls[0]]
    rules = [*URL_RULES, ("allow", "net", "/es/"), ("block", "example.com", "/englis")]
    rows = [(k if k != 205 else 204, u, "h", "kept?") for k, u in enumerate(urls)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, verdict string")
    out = filter_urls(pages, rules_frame(spark, rules))
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in out.collect()), key=str)
    assert got == sorted(((r[0], *plain_verdict(r[1], rules)) for r in rows), key=str)
    # a host of many labels makes no more expressions than another; repeats come back in number
    long = [(0, "http://" + "a." * 200_000 + "net/fr/x", "", "")] + [(1, "http://x.net/fr/", "", "")] * 7
    monkeypatch.setattr(url_filter, "REPEATS", 3)
    out = filter_urls(spark.createDataFrame(long, pages.schema), rules_frame(spark, rules)).collect()
    assert sorted((r.page_id, r.rule, r.verdict) for r in out) == [(0, "net/fr/", "block")] + [(1, "net/fr/", "block")] * 7
    none = filter_urls(pages, rules_frame(spark, []))
    assert none.filter("verdict = 'allow' AND rule IS NULL").count() == len(rows)
    assert filter_urls(pages.limit(0), rules_frame(spark, rules)).count() == 0
    with pytest.raises(ValueError):
        filter_urls(pages, rules_frame(spark, [("maybe", "com", "/")]))


# -- nearest neighbours ---------------------------------------------------------------


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(500, 16)).astype(np.float32)
    v[100:130] = v[0]  # ties
    v[140] *= 1e3
    rows = [(k, v[k].tolist(), 1, "x") for k in range(500)]
    rows += [(500, None, 1, "x"), (520, [0.0] * 16, 1, "x"), (540, [float("nan")] * 16, 1, "x"), (560, [None] * 16, 1, "x")]
    rows += [(580, [1.0, 2.0], 1, "x"), (581, [2.0, 1.0], 1, "x"), rows[40], (None, [1.0] * 16, 1, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, score string")
    out = nearest_neighbours(df, k=7, block_rows=128)
    got: dict = {}
    for r in out.collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    x = v.astype(float)
    for q in range(0, 500, 20):
        score = [float(np.cumsum(x[q] * x[j])[-1]) for j in range(500)]
        want = sorted((j for j in range(500) if j != q), key=lambda j: (-score[j], j))[:7]
        assert [got[q][r][0] for r in range(1, 8)] == want
        assert [got[q][r][1] for r in range(1, 8)] == [score[j] for j in want]
    assert got[580] == {1: (581, 4.0)} and len(got) == 26
    assert nearest_neighbours(df.limit(0)).count() == 0
    few = nearest_neighbours(df.filter("vec_id < 4 OR vec_id = 200"), k=20, block_rows=2).collect()
    assert [(r.query_id, r["rank"]) for r in sorted(few, key=lambda r: (r.query_id, r["rank"]))] == [
        (q, n) for q in (0, 200) for n in range(1, 5)
    ]


def test_quantisation_bound():
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(40, 24)), rng.normal(size=(50, 24)) * rng.uniform(0.01, 100, (50, 1))
    (qa, sa, ea), (qb, sb, eb) = quantised(a), quantised(b)
    assert qa.dtype == qb.dtype == np.int8
    got = tile_product(qa, qb) * sa[:, None] * sb
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    assert (np.abs(got - a @ b.T) <= ea[:, None] * nb + (na + ea)[:, None] * eb).all()


# -- PII ------------------------------------------------------------------------------


def plain_spans(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0])):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m[0])) <= 15]


def test_base_spans_are_the_patterns():
    rng = random.Random(4)
    parts = [*"a1234567890.@-+ ().%_é\n", "1.2.3.4", "a@b.c", "4117250150314303", "+1 (886) 555-9674", "255", "999999999999999999999"]
    for _ in range(20000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        assert base_spans(t) == plain_spans(t), t
    for long in ("a" * 300_000, "1" * 300_000, "1." * 200_000, "a@" * 100_000, "+1" * 100_000):
        base_spans(long)


def test_personal_data(spark):
    texts = ["mail é bob@ex.com or 10.0.0.1, +1 (555) 555-0199.", "card 4117250150314303", None, "", "nothing 12 here", "mail joe (at) foo (dot) com please"]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, spans string")
    rows = {r.doc_id: r for r in find_personal_data(df).collect()}
    for k, t in enumerate(texts):
        base = [tuple(s) for s in rows[k].base_spans]
        assert base == plain_spans(t or "")
        assert set(base) <= {tuple(s) for s in rows[k].spans}
    assert [s.kind for s in rows[5].spans] == ["email"] and not rows[4].spans
    assert find_personal_data(df.limit(0)).count() == 0


def test_field_adds_and_leaves_alone():
    field = trained_field()
    added = find_spans("call (555) 123-4567 now", field)[1]
    assert added == [("phone", 5, 19)]
    run = "from +1 (269) 555-3296 4524132264652876 today"  # too many digits for one phone
    assert [s[0] for s in find_spans(run, field)[1]] == ["card", "phone"]
    for clean in ("on 2024-05-06 and 12:33:44", "id 6838a6ec953eec92", 'token = "6838a6ec953eec92e8f68d7c24ee4c3f71d4f592" x', "version 1.2.30"):
        assert find_spans(clean, field)[1] == []


def test_field_finds_all_of_a_long_list():
    one = "call (555) 123-4567 now\n"
    assert find_spans(one * 200, trained_field())[1] == [("phone", 24 * k + 5, 24 * k + 19) for k in range(200)]


def test_regions_hold_whole_tokens():
    field = trained_field()
    find = lambda t: [t[s:e] for _, s, e in find_spans(t, field)[1]]
    for address in (
        "jonathan.maximilian.featherstonehaugh [at] example.com",
        "firstname.middlename.lastname (at) computing-science (dot) university (dot) edu",
        "bob at example dot org",
    ):
        assert find(f"please write {address} now") == [address]
    assert len(find(" ".join(["(555) 123-4567,"] * 60))) == 60
    for long in ("1 " * 5000, "a" * 300_000 + " 5 " + "b" * 300_000, "@" * 20_000, "(" * 100_000 + "5"):
        find_spans(long, field)


def segmentations(field, text, row, at=0, last=0):
    """Every segmentation of a row of tokens with its score, by plain recursion."""
    if at == len(row):
        yield 0.0, ()
        return
    moves = field.moves()
    ways = [(at + 1, 0, 0.0)]
    for i, j, kind in field.candidates(text, row):
        if i == at:
            score = field.score(segment_features(text, row[i][0], row[j - 1][1], kind))
            ways.append((j, LABELS.index(kind), score))
    for end, label, score in ways:
        own = ((LABELS[label], row[at][0], row[end - 1][1]),) if label else ()
        for rest, spans in segmentations(field, text, row, end, label):
            yield moves[last][label] + score + rest, own + spans


def test_decoding_is_the_best_of_all_segmentations():
    rng = random.Random(8)
    seen = 0
    for k in range(60):
        text = "".join(rng.choice(["12", "555", ".", "-", " ", "1234567", "(", ")", "x", "8 ", "@", "dot"]) for _ in range(9)) + "9"
        for row in regions(text, []):
            names = {f for i, j, kind in trained_field().candidates(text, row) for f in segment_features(text, row[i][0], row[j - 1][1], kind)}
            weights = {f: rng.gauss(0, 1) for f in sorted(names)}
            field = SemiMarkov(weights | {f"{a}>{b}": rng.gauss(0, 1) for a in LABELS for b in LABELS if a or b})
            every = sorted(segmentations(field, text, row), key=lambda x: -x[0])
            seen += len(every) > 1
            if len(every) == 1 or every[0][0] - every[1][0] > 1e-9:
                assert tuple(field.decode(text, row)) == every[0][1]
    assert seen > 20


def test_slope_is_that_of_the_likelihood():
    """The gradient against differences of the log-likelihood over all segmentations."""
    text, kinds = "call 555 123 4567 x", ("phone", 5, 17)
    row = regions(text, [])[0]
    gold = {(next(i for i, t in enumerate(row) if t[0] == 5), next(i + 1 for i, t in enumerate(row) if t[1] == 17), "phone")}
    weights = {"phone": 0.3, ">phone": -0.2, "phone>": 0.4, "phone|n10": 0.1, "phone|g3": 0.2}

    def likelihood(w):
        every = list(segmentations(SemiMarkov(w), text, row))
        own = next(score for score, spans in every if spans == (kinds,))
        return own - np.logaddexp.reduce([score for score, _ in every])

    slope = SemiMarkov(weights).gradient(text, row, gold)
    for f in weights:
        change = (likelihood(weights | {f: weights[f] + 1e-5}) - likelihood(weights | {f: weights[f] - 1e-5})) / 2e-5
        assert abs(change - slope.get(f, 0.0)) < 1e-3


def test_held_out_spans():
    field, right, found, there = trained_field(), 0, 0, 0
    for text, span in _sentences(77, 800):
        got, want = set(find_spans(text, field)[1]), {span} if span else set()
        right, found, there = right + len(got & want), found + len(got), there + len(want)
    assert right / found > 0.88 and right / there > 0.88


# -- HTML -------------------------------------------------------------------------------


def test_blocks_survive_broken_markup():
    assert [b[0] for b in leaf_blocks("a&amp;b <b>c</b>d<p>x<p>y &lt; z<br>w")] == ["a&b cd", "x", "y < z w"]
    assert leaf_blocks("<script>var t='</p>';</script><style>p{}</style><!-- x -->") == []
    assert [b[0] for b in leaf_blocks("< 3 <p title='a>b'>t\u00a0\n u</div>")] == ["< 3", "t u"]
    leaf_blocks('<a href="x' * 20000)
    leaf_blocks("<div>" * 20000 + "deep")


def test_held_out_accuracy():
    chain, right, total = trained_chain(), 0, 0
    for page, labels in labelled_pages(99, 150):
        found = chain.decode(block_features(leaf_blocks(page)))
        right += sum(a == b for a, (_, b) in zip(found, labels, strict=True))
        total += len(labels)
    assert right / total > 0.98


def test_held_out_names():
    """Parts whose names the training never saw."""
    chain, right, total = trained_chain(), 0, 0
    other = "gutter strip rail crumbs shelf panel teaser follow ticker".split()
    for page, labels in labelled_pages(98, 150, other, "copy prose essay column chapter".split()):
        found = chain.decode(block_features(leaf_blocks(page)))
        right += sum(a == b for a, (_, b) in zip(found, labels, strict=True))
        total += len(labels)
    assert right / total > 0.93


def test_labels_are_the_best_of_all():
    rng = random.Random(3)
    for n in range(1, 9):
        chain = HtmlChain()
        chain.moves = [[rng.gauss(0, 1) for _ in "ab"] for _ in "ab"]
        rows = [[f"f{rng.randint(0, 9)}" for _ in range(3)] for _ in range(n)]
        chain.weights = {f"f{k}": rng.gauss(0, 1) for k in range(10)}

        def score(labels, chain=chain, rows=rows):
            own = sum(sum(chain.weights[f] for f in row) for row, label in zip(rows, labels, strict=True) if label)
            return own + sum(chain.moves[a][b] for a, b in zip(labels, labels[1:], strict=False))

        assert tuple(chain.decode(rows)) == max(itertools.product((0, 1), repeat=n), key=score)


def test_any_depth_counts_and_time_is_linear():
    chain = trained_chain()
    deep = "<nav>" + "<div>" * 90 + "Home links here" + "</div>" * 90 + "</nav><article><p>Main text is here, really.</p></article>"
    assert main_text(deep, chain) == "Main text is here, really."
    bare = "<p>Just a paragraph of text with several words.</p>"
    assert main_text(bare, chain) == bare[3:-4]
    began = time.time()
    for source in ("<div>" * 20000 + "x</b></q></section>" * 20000, '<a "' * 50000, "<svg/>" * 20000, "<svg>" * 20000 + "<p>text"):
        main_text(source, chain)
    assert time.time() - began < 20
    assert main_text("<article><p>One two three four five.</p><svg viewBox='0'/><p>Six seven eight nine ten.</p></article>", chain) == (
        "One two three four five. Six seven eight nine ten."
    )


def test_main_text(spark):
    page = (
        "<html><head><title>T</title></head><body><nav><a href=/>Home</a></nav><div class='ad'>Buy now.</div><article><h1>Head</h1>"
        "<p>First <b>bold</b> text &amp; more.</p><aside>Related things.</aside></article><div class='comments'><p>Nice one.</p></div>"
        "<footer>&copy; x</footer></body></html>"
    )
    df = spark.createDataFrame([(0, "u", page, 1), (1, None, None, 1), (2, "u", "", 1)], "page_id long, url string, html string, n_chars int")
    rows = {r.page_id: r for r in extract_main_text(df).collect()}
    assert rows[0].text == "Head First bold text & more." and rows[0].n_chars == len(rows[0].text)
    assert rows[1].text == rows[2].text == "" and rows[1].n_chars == 0
    assert main_text(None, trained_chain()) == ""
    assert extract_main_text(df.limit(0)).count() == 0


# -- language and toxicity ----------------------------------------------------------------

LANGS = {"aa": "zul abat toro miki", "bb": "xex yry wuw pip", "cc": "nom oron elen sas"}


def test_languages(spark):
    rng = random.Random(6)
    text = lambda lang, n=40: " ".join(rng.choice(LANGS[lang].split()) for _ in range(n))
    docs = spark.createDataFrame([(k, text(lang), lang) for k in range(60) for lang in LANGS], "doc_id long, text string, lang string")
    model = train_text_model(docs)
    assert model.languages == ["aa", "bb", "cc"]
    pages, truth = [], {}
    for k in range(120):
        lang = rng.choice(list(LANGS))
        declared = lang if rng.random() < 0.8 else rng.choice(list(LANGS))
        body = text(lang) if k % 10 else ""
        pages.append((k, f"http://w{k % 3}.{lang}.org/{k}", f"<html lang='{declared}'><body>{body}</body></html>", 1))
        truth[k] = lang
    pages += [(200, None, None, 1), (201, "x", "", 1), pages[0]]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, lang int")
    out = identify_languages(df, model).collect()
    assert len(out) == 123 and all(0 < r.confidence <= 1 for r in out)
    assert all(r.lang == truth[r.page_id] for r in out if r.page_id in truth)
    assert identify_languages(df.limit(0), model).count() == 0


def plain_languages(pages, model):
    """The posterior of each page, page by page and level by level."""
    soft = lambda x: np.exp(np.array(x) - max(x)) / np.exp(np.array(x) - max(x)).sum()
    n, rows = len(model.languages), []
    for _, url, html in pages:
        host = plain_verdict(url, [])[0]
        levels = (host.split(".")[-1], ".".join(host.split(".")[-2:]), host)
        score = model.scores(visible_text(html or ""))
        rows.append((levels, declared_language(html or ""), np.array(score), soft(score)))
    out = []
    for k, (levels, declared, score, _) in enumerate(rows):
        rest = [r for j, r in enumerate(rows) if j != k]
        prior = (sum((r[3] for r in rest), np.zeros(n)) + 1) / (len(rest) + n)
        for level in range(3):
            own = [r[3] for r in rest if r[0][: level + 1] == levels[: level + 1]]
            prior = (sum(own, np.zeros(n)) + PRIOR_STRENGTH * prior) / (len(own) + PRIOR_STRENGTH)
        same = sum((r[3] for r in rows if r[1] == declared), np.zeros(n))
        said = (same + CELL) / (sum(r[3] for r in rows) + CELL * len({r[1] for r in rows}))
        post = soft(score + np.log(prior) + np.log(said))
        out.append((model.languages[int(post.argmax())], float(post.max())))
    return out


def test_languages_by_brute_force(spark):
    rng = random.Random(16)
    docs = spark.createDataFrame([(k, LANGS[x], x) for k in range(20) for x in LANGS], "doc_id long, text string, lang string")
    model = train_text_model(docs.union(docs))
    pages = []
    for k in range(80):
        words = " ".join(rng.choice(LANGS[rng.choice(list(LANGS))].split()) for _ in range(rng.randint(0, 6)))
        tag = rng.choice(["<html lang='aa'>", "<html xml:lang=bb-XX>", "<meta http-equiv=Content-Language content='cc'>", "", "<html>"])
        pages.append((k, rng.choice([f"http://w{k % 5}.d{k % 3}.s{k % 4}/{k}", "http://S1:8080/", "nothing", None]), tag + "<p>" + words))
    pages += [(90, None, None), pages[0], pages[0]]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    want = sorted((p[0], lang, round(c, 9)) for p, (lang, c) in zip(pages, plain_languages(pages, model), strict=True))
    assert sorted((r.page_id, r.lang, round(r.confidence, 9)) for r in identify_languages(df, model).collect()) == want


def test_markup_of_any_kind_takes_linear_time():
    assert visible_text("a<b>c</b><!-- x --><script>var i='<p>'</script>d<style>e</style> < 3").split() == ["a", "c", "d", "<", "3"]
    assert visible_text("<script>x").split() == ["x"] and visible_text("<!-- <p>y").split() == ["y"]
    assert declared_language('<HTML class="x" lang = "EN-us">') == "en" == declared_language("<html xml:lang='en'>")
    assert declared_language('<html data-lang="xx"><meta charset=u><meta content="fr, en" http-equiv="content-language">') == "fr"
    assert declared_language("<html>") == declared_language("") == ""
    began = time.time()
    for source in ("<script " * 100_000, "<!--" * 100_000, "<" * 300_000, "<html " * 100_000, "<meta " * 100_000, "<meta >" * 50_000, "<head><script>" * 50_000):
        visible_text(source), declared_language(source)
    assert time.time() - began < 10


def test_toxicity_chain(spark):
    rng = random.Random(7)
    plain = ["stone", "river", "cloud", "walk", "green", "paper", "seven", "night"]
    rows, labels = [], []
    for k in range(400):
        w = [rng.choice(plain) for _ in range(30)]
        rude, threat = rng.random() < 0.3, rng.random() < 0.2
        if rude:
            w[rng.randrange(30)] = rng.choice(["grubling", "grubbish"])
        if threat:
            w[rng.randrange(30)] = "smashyou"
        rows.append((k, " ".join(w), 0.5))
        labels.append((k, int(rude), int(threat), int(rude or threat)))
    docs = spark.createDataFrame([*rows, (900, None, 0.1), (901, "", 0.1), (902, "GRUBBER " + "stone " * 20000, 0.1)], "doc_id long, text string, p_toxic double")
    table = spark.createDataFrame([*labels[:300], (900, None, None, None)], "doc_id long, rude int, threat int, toxic int")
    chain = train_chain(docs, table, ["rude", "threat", "toxic"])
    out = {r.doc_id: r for r in score_toxicity(docs, chain).collect()}
    held = [out[k].toxic == bool(labels[k][3]) for k in range(300, 400)]
    assert sum(held) >= 97 and not out[900].toxic and not out[901].toxic and out[902].toxic
    assert len(chain.weights[2]) == len(chain.weights[0]) + 2  # earlier categories are features
    none = train_chain(docs, table.limit(0), ["toxic"])
    assert score_toxicity(docs, none).agg(F.max("p_toxic")).first()[0] == 0.5
    assert score_toxicity(docs.limit(0), chain).count() == 0


def test_toxicity_of_repeated_rows(spark):
    """Repeated ids count once, whatever their number, and names clash with nothing."""
    rows = [(k, "grubling stone" if k % 2 else "river stone", "x") for k in range(40)] + [(1, "grubling stone", "x")] * 300
    docs = spark.createDataFrame([*rows, (None, None, "x")], "doc_id long, text string, id string")
    table = spark.createDataFrame([(k, k % 2) for k in range(40)] * 3 + [(None, 1), (1, None)], "doc_id long, toxic int")
    chain = train_chain(docs, table, ["toxic"])
    once = train_chain(docs.distinct(), table.distinct(), ["toxic"])
    assert chain.index == once.index and all(np.allclose(a, b) for a, b in zip(chain.weights, once.weights, strict=True))
    out = score_toxicity(docs, chain)
    assert out.columns == ["doc_id", "text", "id", "p_toxic", "toxic"] and out.count() == 341


def test_features_of_batches_are_those_of_texts():
    rng = random.Random(9)
    words = ["Éclair", "éclairs", "stone", "Stones", "a", "ab", "abc", "grubling", "GRUB", "don't", "x1y", "中文"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 500))) for _ in range(60)] + [None, "", "a " * 3000]
    every = [features_of(t) for t in texts]
    index = {f: k for k, f in enumerate(sorted(set().union(*every))) if k % 3}
    row, feature = Vocabulary(index).active(pa.array(texts))
    for k, found in enumerate(every):
        assert feature[row == k].tolist() == sorted(index[f] for f in found if f in index)
    empty = Vocabulary({}).active(pa.array(texts))
    assert len(empty[0]) == len(empty[1]) == 0


def test_chain_is_trained_on_out_of_fold_odds():
    """Each model by hand: the second one's extra feature comes from models that did not see the row."""
    rng = np.random.default_rng(4)
    rows = [np.flatnonzero(rng.random(12) < 0.4) for _ in range(60)]
    labels = np.array([[0 in r, (0 in r) ^ (1 in r)] for r in rows]).astype(int)
    folds = rng.integers(0, FOLDS, 60)
    masks = [np.arange(12) != f for f in range(FOLDS)] + [np.ones(12, bool)]
    chain = fit_chain(["a", "b"], {f"f{k}1": k for k in range(12)}, rows, labels, folds, masks)
    unseen = np.zeros(60)
    for f in range(FOLDS):
        cut = [r[r != f] for r in rows]
        own, out = np.flatnonzero(folds != f), np.flatnonzero(folds == f)
        w = _fit([cut[i] for i in own], np.zeros((len(own), 0)), labels[own, 0].astype(float), 12)
        unseen[out] = _odds([cut[i] for i in out], np.zeros((len(out), 0)), w, 12)
    assert np.allclose(chain.weights[0], _fit(rows, np.zeros((60, 0)), labels[:, 0].astype(float), 12))
    assert np.allclose(chain.weights[1], _fit(rows, unseen[:, None], labels[:, 1].astype(float), 12))
    # and predictions by plain sums
    texts = [" ".join(["x"] * 0 + [f"w{chr(97 + k)}" for k in r]) for r in rows]
    chain = Chain(["a", "b"], {f"w{chr(97 + k)}1": k for k in range(12)}, chain.weights)
    by = chain.predict(*Vocabulary(chain.index).active(pa.array(texts)), 60)
    for i, r in enumerate(rows):
        z = min(8.0, max(-8.0, chain.weights[0][r].sum() + chain.weights[0][12]))
        y = min(8.0, max(-8.0, chain.weights[1][r].sum() + chain.weights[1][12] + chain.weights[1][13] * z))
        assert np.isclose(by[0][i], 1 / (1 + np.exp(-z))) and np.isclose(by[1][i], 1 / (1 + np.exp(-y)))
