"""No text of a page is lost, whatever its figures hold."""

import hashlib
import random
import re

from graphloom.llm import media


def items(html):
    return [(kind, text, caption) for _, kind, text, _, caption in media.parse(html)]


def test_captions_without_media():
    assert items("a<figure><figcaption>Cap</figcaption><pre>x</pre></figure>b") == [("text", t, None) for t in ("a", "Cap", "x", "b")]
    assert items("<figure><pre>x</pre><figcaption>Cap</figcaption></figure>b") == [("text", t, None) for t in ("x", "Cap", "b")]
    assert items("<figure><img src=a><figcaption>Cap</figure><p>rest") == [("media", None, "Cap"), ("text", "rest", None)]
    assert items("<figure><figcaption>Cap <b>more") == [("text", "Cap more", None)]
    assert items("<figcaption>stray</figcaption><figure><img src=a></figure>") == [("text", "stray", None), ("media", None, None)]


def test_every_word_stays():
    rng = random.Random(3)
    for n in range(500):
        html = ""
        for i in range(rng.randrange(1, 6)):
            body = [f"<figcaption>w{n}c{i}" + rng.choice(["</figcaption>", ""]), rng.choice(["<img src=a>", f"<pre>w{n}p{i}</pre>"])]
            html += rng.choice([f"<p>w{n}t{i}</p>", f"<figure>{''.join(rng.sample(body, 2))}" + rng.choice(["</figure>", "</figure>", ""])])
        got = " ".join(x for item in items(html) for x in item[1:] if x)
        assert set(re.findall(r"w\d+[cpt]\d+", html)) <= set(re.findall(r"w\d+[cpt]\d+", got)), html


def test_silent_elements_end_with_their_parent():
    assert items("<article><p>a<template>hid<p>x</article><p>after") == [("text", "a", None), ("text", "after", None)]
    assert items("<div><noscript>n<img src=z></noscript>t</div>") == [("text", "t", None)]
    assert media.parse('<img srcset="u1 1x, u2 2x"><img data-src=" q "><source srcset="s">')[:2] == [(0, "media", None, "u1", None), (1, "media", None, "q", None)]
    deep = "<p>" * 50_000 + "<b>x</b>" * 50_000
    assert len(media.parse(deep)) == 1


def test_illustrated_pages(spark, make_docs, odd_texts):
    """Positions, texts and captions of whole pages against a plain reading of the same page."""
    pages = [(i, f"<html><article><p>One {i}<p>Two<figure><img src=far{i}><figcaption>Far</figcaption></figure>{end}<p>Tail") for i, end in enumerate(["</article>", "", "</article></article>"] * 4)] + [(90, "no document"), (1, "again"), (3, None)]
    docs = make_docs(list(enumerate(odd_texts)))
    frame = spark.createDataFrame([(i, h, "k", 1) for i, h in pages], "page_id long, html string, kind string, position int")
    got = sorted((tuple(r[:6]) + (r.n_bytes,) for r in media.illustrated_pages(frame, docs).select("page_id", "position", "kind", "text", "reference", "caption", "n_bytes").collect()), key=str)
    want = []
    texts = dict(enumerate(odd_texts))
    for i, html in pages:
        html = html or ""
        if i in texts:
            raw = (texts[i] or "").encode()
            name = "sha256:" + hashlib.sha256(media.encode(raw)).hexdigest()
            figure = f'<figure><img src="{name}" alt="payload"><figcaption>Payload of document {i}</figcaption></figure>'
            head, close, tail = html.partition("</article>")
            html = head + figure + close + tail
        for position, kind, text, reference, caption in media.parse(html):
            want.append((i, position, kind, text, reference, caption, len(raw) if reference and reference.startswith("sha256:") else None))
    assert got == sorted(want, key=str) and sum(r[6] is not None for r in got) == 12
    assert media.illustrated_pages(frame.limit(0), docs).count() == 0
