"""License templates against regular expressions that backtrack over the words."""

import random
import re

import pytest

from orderpulse.llm import licenses

SMALL = [
    ("under the <<optional>>plain <<optional>>old<<end>><<end>> license", "a"),
    ("granted <<any 3>> to <<any 1>> all", "b"),
    ("to all <<optional>>the<<end>>", "c"),
    ("under license <<any 2>>", "d"),
]
BASE = [("under the", "x"), ("to to", "a")]


def slow_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def pattern(template):
    """The template as a regular expression over words that are each written with a space in front."""
    made = ""
    for part in re.split(r"(<<.*?>>)", template):
        if part == "<<optional>>":
            made += "(?:"
        elif part == "<<end>>":
            made += ")?"
        elif part.startswith("<<any"):
            made += f"(?: [^ ]+){{0,{part[6:-2]}}}"
        else:
            made += "".join(f" {w}" for w in slow_words(part))
    return re.compile(made + "(?= |$)")


def mandatory(template):
    while "<<optional>>" in template:
        template = re.sub(r"<<optional>>((?!<<optional>>).)*?<<end>>", "", template, flags=re.S)
    return len(slow_words(re.sub("<<any .*?>>", "", template)))


def slow(text, base, templates):
    found = slow_words(text)
    whole = "".join(f" {w}" for w in found)
    at = [m.start() for m in re.finditer(" ", whole)]
    own = [k for t, _ in base for k, i in enumerate(at) if pattern(t).match(whole, i)]
    hit = [(t, label, (t, label) in base) for t, label in [*base, *templates] if any(pattern(t).match(whole, i) for i in at)]
    size = max((mandatory(t) for t, _, _ in hit), default=0)
    return (len(found), len(own), min(own, default=None), max(own, default=None), ",".join(sorted({x for _, x, plain in hit if plain})), ",".join(sorted({x for _, x, _ in hit})), size / (size + 4))


def test_random_texts_and_small_templates(spark):
    rng = random.Random(1)
    vocabulary = "under the plain old license granted to all Some É9 -".split()
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 25))) for _ in range(600)] + [None, "", "!?", "under the " * 5000]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(None, "to to", "clash")] * 2, "doc_id long, text string, labels string").repartition(4)
    got = licenses.scan(docs, BASE, SMALL).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        text = "to to" if r["doc_id"] is None else texts[r["doc_id"]]
        assert tuple(r)[1:] == slow(text, BASE, SMALL) if len(text or "") < 9000 else r["n_base"] == 5000


def test_every_template_accepts_its_own_wording(spark):
    for text, label in licenses.TEMPLATES:
        with_all = re.sub(r"<<(optional|end)>>", " ", text)
        without = text
        while "<<optional>>" in without:
            without = re.sub(r"<<optional>>((?!<<optional>>).)*?<<end>>", " ", without, flags=re.S)
        for made in (with_all, without):
            for filler in ("", "w"):
                said = f"Preface. {re.sub('<<any .*?>>', filler, made).upper()} -- and more."
                automaton = licenses.Automaton([], [(text, label)])
                assert len(list(automaton.places(licenses.words(said.encode())))) == 1, text
        # One word of the mandatory wording changed: not accepted.
        wrong = re.sub("<<any .*?>>", "", without).split()
        wrong[len(wrong) // 2] = "otherwise"
        assert not list(licenses.Automaton([], [(text, label)]).places(licenses.words(" ".join(wrong).encode()))), text


def test_known_lines(spark):
    lines = {
        "Licensed under the Apache License, Version 2.0. Copyright me": "apache-2",
        "Released under the MIT License": "mit",
        "This work is licensed under the GNU General Public License, version 3.": "gpl-3",
        "Licensed under CC BY-NC 4.0": "cc-by-nc",
        "This license is free": "",
    }
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(lines)], "doc_id int, text string")
    assert {r["doc_id"]: r["labels"] for r in licenses.scan(docs).collect()} == dict(enumerate(lines.values()))
    assert licenses.scan(docs.limit(0)).collect() == []


def test_malformed_templates():
    for text in ("<<optional>>a<<end>>", "<<any 2>> a", "a <<optional>> b"):
        with pytest.raises(ValueError):
            licenses.Automaton([], [(text, "x")])
