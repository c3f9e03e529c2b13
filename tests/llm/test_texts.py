import math
import os
import random
import time
import zlib

import numpy as np
import pytest

from ferrovia.llm import html_text, language, licenses, mixing

PAGE = "page_id long, url string, html string, text string"


@pytest.fixture(scope="module")
def weights():
    rng = random.Random(4)
    say = lambda n: " ".join(rng.choice(["aber", "one", "two", "three"]) for _ in range(n))
    pages = [f"<html><body><nav><ul>{''.join(f'<li><a href=x>{say(1)}</a></li>' for _ in range(6))}</ul></nav><div class=ad>{say(5)}</div><article><h1>{say(4)}</h1>{''.join(f'<p>{say(30)}</p>' for _ in range(5))}</article><footer>{say(4)}</footer></body></html>" for _ in range(20)]
    counts: dict = {}
    for p in pages:
        for k, n in html_text.count_features(p).items():
            counts[k] = counts.get(k, 0) + n
    return html_text.fit_weights(counts)


def test_words_score_above_zero_and_tags_below(weights):
    assert all((w > 0) == (f in ("word", "linked word")) for f, w in weights.items())


@pytest.mark.parametrize(
    "html, want",
    [
        (None, ""),
        ("", ""),
        ("<p>", ""),
        ("plain words", "plain words"),
        ("<nav>menu</nav><article><h1>T &amp; U</h1><p><b>One\n two.<br><p>x&nbsp;y &#233;</p></article><footer>f</footer>", "T & U\n\nOne two.\n\nx y é"),
        ("<body><script>var t='</p><p>no</p>';</script><style>p{}</style><main><p>yes<!-- no --> w<i>or</i>d</p></main></body>", "yes word"),
        ("<article><p>one</p><aside>no</aside><form><p>no</p></form><div class='social-share'>no</div><p>two</p><section id=comments><p>no no no no no no no no no no</p></section></article>", "one\n\ntwo"),
        ("<article><p>a</p><div class='ad'>no</div><p>z</article>", "a\n\nz"),
        ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>", "a\n\nb\n\nc\n\nd"),
        ("<article><p>x <a href='>'>y</a> z</p><textarea>no</textarea></article>", "x y z"),
        ("<article><p>&lt;p&gt; 1 < 2</p></article>", "<p> 1 < 2"),
        ("<body><nav>menu</nav><h1>T</h1><p>" + "w " * 30 + "</p><p>Wh.</p><div class='page-footer'>no</div><footer>no</footer></body>", "T\n\n" + " ".join(["w"] * 30) + "\n\nWh."),
        ("<div class=cookie-notice>no</div><div id=content><p>" + "w " * 40 + "</p><p>v</p></div><div class=footer>no</div>", " ".join(["w"] * 40) + "\n\nv"),
    ],
)
def test_main_text(weights, html, want):
    assert html_text.extract(html, weights) == want


@pytest.mark.parametrize("name", ["post-form", "ad-hoc", "notice-of-award", "banner-story", "search-results-article", "alert-free", "research related-work", "research search-theory", "siteHeader"])
def test_names_alone_do_not_discard_a_text(weights, name):
    text = " ".join(["word"] * 80)
    for inner in (f"<div class='{name}'><p>{text}</p></div>", f"<main><div class='{name}'><p>{text}</p></div></main>"):
        page = f"<body><nav><a href=x>menu</a></nav>{inner}<div class=comments-area>no no no</div><div id=siteFooter>no</div><footer>no</footer></body>"
        assert html_text.extract(page, weights) == text


@pytest.mark.parametrize("name", ["comments-area", "page-footer", "ad", "sidebar-left widget", "cookieNotice", "social-links", "related-posts", "navMenu"])
def test_named_parts_are_left_out(weights, name):
    text = " ".join(["word"] * 60)
    for page in (f"<article><p>{text}</p><div class='{name}'><p>no no no</p></div></article>", f"<body><div id=story><p>{text}</p></div><div class='{name}'><p>no no no</p></div></body>"):
        assert html_text.extract(page, weights) == text
    many = " ".join(["no"] * 300)
    if name in ("comments-area", "ad"):
        assert html_text.extract(f"<body><div id=story><p>{text}</p></div><div class='{name}'><p>{many}</p></div></body>", weights) == text


def test_names_are_learned():
    page = "<body><div class=zap>" + "no " * 30 + "</div><main><div class='story-form'>" + "yes " * 40 + "</div></main></body>"
    counts: dict = {}
    for _ in range(3):
        for k, n in html_text.count_names(page).items():
            counts[k] = counts.get(k, 0) + n
    learned = html_text.fit_names(counts)
    assert learned == {"zap": 0.0, "story-form": 1.0}
    weights = html_text.PLAIN_WEIGHTS
    assert html_text.extract("<body><div class=zap>no no no</div><p>a b c d</p><div class='story-form'>e f g h i j k</div></body>", weights, learned) == "a b c d\n\ne f g h i j k"


def test_headlines_of_an_article_stay(weights):
    page = "<body><header><h1>Site</h1></header><article><header><h1>Title</h1><p>by me</p><nav><h2>no</h2></nav></header><p>" + "w " * 20 + "</p></article></body>"
    assert html_text.extract(page, weights) == "Title\n\n" + " ".join(["w"] * 20)


@pytest.mark.parametrize("page", ["<p " * 300_000, "<p>" + "a <b " * 200_000, "<p " * 200_000 + '"', "<a b='" * 100_000 + ">x", "<a b='c\">" * 100_000, "<div>x" * 60_000, "<script>" + "</script" * 100_000, "<!-- " * 100_000 + ">", "&#" * 200_000, "<div class='" + "ad " * 100_000 + "'>x</div>", "<li>" * 50_000 + "</ul>" * 50_000, "<a>" * 50_000 + "x <b>" * 50_000])
def test_hostile_pages_take_linear_time(weights, page):
    began = time.process_time()
    html_text.extract(page, weights)
    assert time.process_time() - began < 8 * max(1.0, len(page) / 1e6)


def test_best_region_against_all_regions():
    rng = random.Random(12)
    for _ in range(200):
        parts = [rng.choice(["<p>", "<li>", "<h2>", "<div>", "<a href=x>", "</a>", "</div>", "word ", "two words ", "<br>", "<nav>n</nav>"]) for _ in range(rng.randrange(1, 25))]
        blocks, tags, _ = html_text.read_page("".join(parts))
        weights = {"word": rng.uniform(0.3, 2), "linked word": 0.25, **{t: -rng.uniform(0.02, 3) for t in ("p", "li", "h2", "div", "br", "nav", "inline")}}

        def total(first, last):
            words = sum((b.words - b.linked) * weights["word"] + b.linked * weights["linked word"] for b in blocks[first : last + 1] if not b.apart)
            return words + sum(weights.get(t, weights["inline"]) for place, t in tags if first < place <= last)

        first, last = html_text.best_region(blocks, tags, weights)
        best = max((total(a, b) for a in range(len(blocks)) for b in range(a, len(blocks))), default=0.0)
        assert (last < first and best <= 1e-9) or abs(total(first, last) - best) < 1e-9


def test_pages(spark):
    rows = [(1, "u", "<article><p>a b</p></article><nav>no</nav>", "x"), (None, None, None, None), (1, "u", "<article><p>a b</p></article><nav>no</nav>", "x")]
    got = sorted((tuple(r) for r in html_text.extract_text(spark.createDataFrame(rows, PAGE)).collect()), key=str)
    assert got == sorted([(1, "u", "a b", 3), (1, "u", "a b", 3), (None, None, "", 0)], key=str)
    assert html_text.extract_text(spark.createDataFrame([], PAGE)).count() == 0


LICENSED = [
    (1, "Released under the MIT License.\nMIT license; mit-LICENSE"),
    (2, "the GNU General Public\n(license)"),
    (3, "Licensed under CC BY-NC 4.0."),
    (4, "under the license"),
    (5, None),
    (6, ""),
    (7, "omit license apachelicense Ünder MIT K license"),
    (7, "apache\tLicense x general public license"),
    (None, "apache license"),
    (8, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    (9, "Permission is hereby granted, free of charge, to any person"),
]


def test_licenses(spark):
    docs = spark.createDataFrame([(*r, "x", 1) for r in LICENSED], "doc_id long, text string, words string, k1 int")
    got = sorted((tuple(r) for r in licenses.scan_licenses(docs).collect()), key=str)
    want = [
        (1, 9, 3, 3, 7, "mit", "mit", 1.0),
        (2, 5, 1, 2, 2, "gpl", "gpl", 1.0),
        (3, 7, 0, None, None, "", "cc-by-nc", 1.0),
        (4, 3, 0, None, None, "", "", 0.0),
        (5, 0, 0, None, None, "", "", 0.0),
        (6, 0, 0, None, None, "", "", 0.0),
        (7, 7, 0, None, None, "", "", 0.0),
        (7, 6, 2, 0, 3, "apache,gpl", "apache,gpl", 1.0),
        (None, 2, 1, 0, 0, "apache", "apache", 1.0),
        (8, 16, 0, None, None, "", "mit", 1.0),
        (9, 10, 0, None, None, "", "", 0.0),
    ]
    assert got == sorted(want, key=str)
    assert licenses.scan_licenses(docs.limit(0)).count() == 0


def test_notices_broken_over_two_lines(spark):
    notices = {
        "bsd": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that",
        "mit": "x\nPermission is hereby granted, free of charge, to any person obtaining\na copy of this software and so on",
        "mpl": "This Source Code Form is subject to the terms of the Mozilla\n Public License, v. 2.0.",
        "": "Redistribution and use in source and binary forms, with or without\n\nmodification, are permitted " + "x" * 120,
    }
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(notices.values())], "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in licenses.scan_licenses(docs).collect()}
    assert [got[k] for k in range(4)] == list(notices)


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_set_join_against_all_pairs(spark, monkeypatch, threshold):
    monkeypatch.setattr(licenses, "WRAPPED", 30)
    rng = random.Random(6)
    vocabulary = [f"w{k}" for k in range(14)]
    templates = [(f"t{k}", " ".join(rng.sample(vocabulary, rng.randrange(3, 9)))) for k in range(8)]
    docs = [(k, "\n".join(" ".join(rng.choice([*vocabulary, "other", "x"]) for _ in range(rng.randrange(12))) for _ in range(4))) for k in range(60)]
    want = set()
    for d, text in docs:
        split = text.split("\n")
        blocks = [(b, 1, line) for b, line in enumerate(split)] + [(b, 2, f"{x} {y}") for b, (x, y) in enumerate(zip(split, split[1:])) if max(len(x), len(y)) <= 30]
        for b, n, line in blocks:
            for label, words in templates:
                bag = set(words.split())
                if len(bag & set(line.split())) >= math.ceil(threshold * len(bag) - 1e-9):
                    want.add((d, b, n, label, len(bag & set(line.split())) / len(bag)))
    got = licenses.template_matches(spark.createDataFrame(docs, "doc_id long, text string"), templates, threshold)
    assert {(r["k1"], r["block"], r["lines"], r["label"], r["containment"]) for r in got.collect()} == want


def mixable():
    rng = random.Random(8)
    rows = [(k, "w " * rng.randrange(1, 60), f"s{k % 5}" if k % 50 else None) for k in range(3000)] + [(7, "big " * 2000, "s1")]
    return rows + [(1, None, "s1"), (2, "", None), (None, "a b", "s2"), (8, "same x", "s3"), (8, "same x", "s3"), (9, "tiny", "zz")]


@pytest.mark.parametrize("leaf", [2048, 16])
def test_mixing(spark, monkeypatch, leaf):
    monkeypatch.setattr(mixing, "LEAF", leaf)
    monkeypatch.setattr(mixing, "FAN_IN", 4)
    rows = mixable()
    docs = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, source string, size int")
    got = mixing.mix_counts(docs.repartition(3)).collect()
    assert len(got) == len(rows)
    sizes: dict = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, left = {}, set(order)
    while True:
        level = (sum(sizes.values()) - sum(target.values())) / sum(weight[s] for s in left)
        over = {s for s in left if level * weight[s] > 3 * sizes[s]}
        if not over:
            break
        target |= {s: 3.0 * sizes[s] for s in over}
        left -= over
    target |= {s: level * weight[s] for s in left}
    for s in order:
        mine = [r for r in got if r["source"] == s]
        assert {r["source_size"] for r in mine} == {sizes[s]} and mine[0]["target"] == pytest.approx(target[s])
        assert abs(sum(r["copies"] * r["size"] for r in mine) - target[s]) <= (60 if leaf > 16 else 2000)  # small groups can't make up for the longest
        wanted = target[s] / sizes[s]
        assert all(math.floor(wanted) <= r["copies"] <= min(3, math.floor(wanted) + 1) for r in mine)
    again = mixing.mix_counts(docs.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_expectations_stay():
    """But for the shortest, which make up for the rest at the top."""
    size, total = np.array([9, 10, 8, 9, 11, 9, 12, 9, 8, 9] + [1] * 40), np.zeros(50)
    for seed in range(2000):
        total += mixing.round_group(size, np.full(50, 0.5), np.random.default_rng(seed), True)
    assert abs(total / 2000 - 0.5)[:10].max() < 0.05
    size, total = np.array([5, 9, 2, 30, 7, 3, 3, 8, 9, 10, 12, 20]), np.zeros(12)
    for seed in range(4000):
        out = mixing.round_group(size, np.full(12, 0.3), np.random.default_rng(seed), False)
        assert (out < 0).sum() <= 1
        total += np.where(out < 0, 0, out)
    assert (total / 4000 < 0.33).all()


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sources_come_near_their_targets(spark, sf):
    """At most one median document off, also where one document is longer than the whole target."""
    folder = f"/root/testdata/{sf}"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    by: dict = {}
    for r in mixing.op8_mixing(spark, folder).collect():
        by.setdefault((r["source_size"], r["target"]), []).append((r["size"], r["taken"]))
        assert r["taken"] % max(1, r["size"]) == 0 and r["taken"] <= 3 * r["size"]
    for (_, target), rows in by.items():
        assert abs(sum(t for _, t in rows) - target) <= sorted(n for n, _ in rows)[len(rows) // 2]


def test_a_document_longer_than_the_target_is_left():
    for seed in range(50):
        size = np.array([2065, 400, 300, 300, 200, 100, 50, 20, 10])
        out = mixing.round_group(size, np.full(9, 1000 / size.sum()), np.random.default_rng(seed), True)
        assert out[0] == 0 and abs((out * size).sum() - 1000) <= 50
        assert mixing.round_group(np.array([7]), np.array([0.4]), np.random.default_rng(seed), True)[0] in (0, 1)


def test_equal_rows_are_dealt_out(spark, monkeypatch):
    """A third of all rows alike don't meet in one group, nor are they taken or left together."""
    for name, n in (("LEAF", 64), ("TOP", 16), ("CHUNK", 16)):
        monkeypatch.setattr(mixing, name, n)
    rows = [(None, "a b c", "x")] * 600 + [(k, "a " * (k % 9), "x") for k in range(700)] + [(k, "b " * 4, "y") for k in range(700, 900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_counts(docs).collect()
    assert len(got) == len(rows)
    for source in "xy":
        mine = [r for r in got if r["source"] == source]
        assert abs(sum(r["copies"] * r["size"] for r in mine) - mine[0]["target"]) <= 4
    assert len({r["copies"] for r in got if r["doc_id"] is None}) == 2


def test_rows_of_one_id_stay_apart(spark):
    rows = [(1, "a b c", "x", "en", 1), (1, "a b c", "y", "fr", 2), (2, "d e", "z", "de", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, __key string, copies int")
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and {tuple(r) for r in mixed.collect()} <= set(rows)
    counts = {r["source"]: r["copies"] for r in mixing.mix_counts(docs).collect()}
    assert {s: sum(r["source"] == s for r in mixed.collect()) for s in "xyz"} == counts


def test_mixed_rows(spark):
    docs = spark.createDataFrame([(1, "a b c", "x", "k"), (2, "d", "y", None), (None, "e f", "x", "k")], "doc_id long, text string, source string, lang string")
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    counts = {r["text"]: r["copies"] for r in mixing.mix_counts(docs).join(docs.select("doc_id", "text"), "doc_id").collect()}
    rows = [r["text"] for r in mixed.collect()]
    assert all(rows.count(t) == n for t, n in counts.items())
    assert mixing.mix(docs.limit(0)).count() == 0


SPEECH = {"xx": ["ban", "bana", "nab", "abba", "naba"], "yy": ["dot", "doto", "tod", "otto", "todo"]}


def spoken(rng, lang, n):
    return " ".join(rng.choice(SPEECH[lang]) + rng.choice(["", ".", ","]) for _ in range(n))


def test_languages(spark):
    rng = random.Random(2)
    rows = [(k, spoken(rng, ("xx", "yy")[k % 2], 3 + k % 9), ("xx", "yy")[k % 2]) for k in range(300)]
    odd = [(900, None, "xx"), (901, "", None), (902, "12 .. ²", "yy"), (903, "bana " * 3000, None), (None, "dot doto", "yy"), (903, "bana " * 3000, None), (904, "жук", None)]
    docs = spark.createDataFrame([(*r, "q") for r in rows + odd], "doc_id long, text string, lang string, score string")
    got = language.predict(docs).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows + odd)
    assert all(by[k]["lang_pred"] == lang and by[k]["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) for k, _, lang in rows)
    assert [by[k]["lang_pred"] for k in (900, 901, 902, 903, None)] == ["und", "und", "und", "xx", "yy"]
    assert by[902]["score"] == 0 and by[902]["rejected"] and by[904]["rejected"] and not by[903]["rejected"]
    assert all(0 <= r["score"] <= 1 for r in got)
    kept = language.with_known_language(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows) + 3
    assert [r["lang_pred"] for r in language.predict(docs.where("lang IS NULL")).collect()] == ["und"] * 4
    assert language.predict(docs.limit(0)).count() == 0


def test_kneser_ney_against_its_formula():
    """Each probability again from the counts, by recursion, and whole words' scores from these."""
    rng, order = random.Random(7), 3
    words = {lang: [spoken(rng, lang, 1).strip(".,") for _ in range(40)] for lang in SPEECH}
    counts: dict = {}
    for lang, some in words.items():
        grams = counts.setdefault(lang, {})
        for w in some:
            framed = "\x02" * (order - 1) + w + "\x03"
            for k in range(len(w) + 1):
                grams[framed[k : k + order]] = grams.get(framed[k : k + order], 0) + 1
    alphabet = len({c for g in counts.values() for x in g for c in x}) + 1

    def tables(grams):
        out = {order: grams}
        for k in range(order - 1, 0, -1):
            out[k] = {}
            for g in out[k + 1]:
                out[k][g[1:]] = out[k].get(g[1:], 0) + 1
        return out

    def p(by, history, c):
        k = len(history) + 1
        if k > order:
            return p(by, history[1:], c)
        lower = p(by, history[1:], c) if history else 1 / alphabet
        here = {g: n for g, n in by[k].items() if g[:-1] == history}
        if not here:
            return lower
        ones, twos = (sum(n == j for n in by[k].values()) for j in (1, 2))
        d = min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones + twos else 0.5
        total = sum(here.values())
        return max(0.0, here.get(history + c, 0) - d * (history + c in here)) / total + d * len(here) / total * lower

    model = language.LanguageModel(counts, order)
    asked = ["ban", "otto", "bx", "q", "abbatod", words["xx"][0]]
    got, chars = model.score_words(asked)
    for j, lang in enumerate(model.languages):
        by = tables(counts[lang])
        for i, w in enumerate(asked):
            framed = "\x02" * (order - 1) + w + "\x03"
            want = sum(math.log2(p(by, framed[k : k + order - 1], framed[k + order - 1])) for k in range(len(w) + 1))
            assert got[i, j] == pytest.approx(want, abs=1e-3) and chars[i] == len(w) + 1


def test_probabilities_sum_to_one():
    model = language.CharacterModel({"\x02\x02a": 4, "\x02ab": 2, "\x02aa": 1, "aab": 1, "ab\x03": 3, "aa\x03": 1}, 3, 5)
    for before in ("\x02\x02", "\x02a", "ab", "zz"):
        total = 0.0
        for c in "ab\x02\x03q":  # q stands for the one unseen character
            keys = language._keys(np.array([ord(x) for x in before + c], np.uint64), 3)
            total += 2.0 ** model.log2(keys)[-1]
        assert total == pytest.approx(1, abs=1e-5)


@pytest.mark.parametrize("wrapper", ["div class='content has-sidebar'", "div id='page' class='no-sidebar'", "div class='search-layout'", "div class=widget"])
def test_wrappers_named_like_menus(weights, wrapper):
    text = "w " * 30
    inner = f"<p>{text}</p><section id=comments><article><p>no no</p></article></section>"
    assert html_text.extract(f"<body><nav>menu</nav><{wrapper}><article>{inner}</article><div class=sidebar>no</div></div></body>", weights) == text.strip()
    assert html_text.extract(f"<body><nav>menu</nav><{wrapper}><p>{text}</p></div></body>", weights) == text.strip()
