"""What is template goes, what varies stays."""

from __future__ import annotations

from tidebar.llm import template_extract


def texts(spark, bodies: list[str]) -> list[str]:
    d = spark.createDataFrame([(i, f"http://h.example.org/{i}", f"<html><body>{b}</body></html>") for i, b in enumerate(bodies)], "page_id long, url string, html string")
    return [r.text for r in template_extract.main_texts(d).orderBy("page_id").collect()]


def test_title_and_lead_outside_the_body_stay(spark):
    got = texts(spark, [f"<article><h1>Head {i}</h1><div class=lead>Lead {i}</div><div class=body>Long body text number {i} goes on and on and on {i}</div></article>" for i in range(6)])
    assert got == [f"Head {i}\nLead {i}\nLong body text number {i} goes on and on and on {i}" for i in range(6)]


def test_unlabelled_template_text_in_the_article_goes(spark):
    box = "<div><p>Read more of this every week</p></div>"
    got = texts(spark, [f"<article><h1>Head {i}</h1><p>Text {i}</p><p>Ask us by mail</p>{box if i % 2 else ''}<p>End {i}</p></article>" for i in range(8)])
    assert got == [f"Head {i}\nText {i}\nEnd {i}" for i in range(8)]


def test_text_of_some_pages_without_an_element_of_its_own_stays(spark):
    got = texts(spark, [f"<article><p>Text {i}</p><p>{'Same words' if i < 3 else f'Other {i}'}</p></article>" for i in range(8)])
    assert got[0] == "Text 0\nSame words" and got[7] == "Text 7\nOther 7"


def test_equal_vectors_in_different_slots_are_different_classes(spark):
    """The aside stands in the pages where the line does by chance; the line is no part of its class."""
    got = texts(spark, [f"{'<aside><i>x</i><div>Box</div></aside>' if i % 2 else ''}<article><p>Text {i}</p><section><p>Own {i}</p>{'<p>A line</p>' if i % 2 else f'<p>Else {i}</p>'}</section></article>" for i in range(8)])
    assert got[1] == "Text 1\nOwn 1\nA line" and got[2] == "Text 2\nOwn 2\nElse 2"


def test_copies_of_a_page_keep_their_title_and_quotation(spark):
    """Two pages are copies with a quotation; what only they hold is theirs, however it is nested."""
    plain = [f"<article><h1>Head {i}</h1><p>Own text number {i} is here.</p><p>The end of {i}.</p></article>" for i in range(2, 6)]
    copy = "<article><h1>Head 0</h1><p>Own text number 0 is here.</p><blockquote><p>As it was said</p></blockquote><p>The end of 0.</p></article>"
    got = texts(spark, [copy, copy, *plain])
    assert got[:2] == ["Head 0\nOwn text number 0 is here.\nAs it was said\nThe end of 0."] * 2
    assert got[2:] == [f"Head {i}\nOwn text number {i} is here.\nThe end of {i}." for i in range(2, 6)]
    third = copy.replace("number 0", "number 00")  # a near copy is no template either
    assert texts(spark, [copy, third, *plain])[1] == "Head 0\nOwn text number 00 is here.\nAs it was said\nThe end of 0."
    assert texts(spark, [copy] * 40 + plain)[3] == got[0]  # most rows are copies of one page


def test_a_title_shared_by_some_pages_is_no_part_of_a_box_they_share(spark):
    box = "<div class=box><p>Read more of this every week</p></div>"
    got = texts(spark, [f"<article><h1>{'Weekly news' if i < 4 else f'Head {i}'}</h1>{box if i < 4 else ''}<p>Text {i}</p></article>" for i in range(9)])
    assert got[0] == "Weekly news\nText 0" and got[8] == "Head 8\nText 8"


def test_an_image_in_a_line_does_not_end_it(spark):
    assert texts(spark, ["<article><p>one <img src=x> two<wbr> three<br>four</p></article>"]) == ["one two three\nfour"]


def brute_template(pages: list[str]) -> set[tuple[str, str]]:
    """(path, text) of the template of one host, by vectors written out over its different pages."""
    read = [template_extract.Page(p) for p in sorted(set(pages))]
    n = len(read)
    vectors: dict[tuple, list[int]] = {}
    for k, r in enumerate(read):
        for path in [t[1:] for t in r.tokens.elements()]:
            vectors.setdefault((path, None), [0] * n)[k] += 1
        for path, text, _, _ in r.blocks:
            vectors.setdefault((path, text), [0] * n)[k] += 1
    pages_of = {k: sum(x > 0 for x in v) for k, v in vectors.items()}
    held = {k for k in vectors if pages_of[k] >= max(2, -(-3 * n // 10))}

    def slot(k: tuple) -> str:
        """The nearest element around it that occurs otherwise."""
        path = k[0]
        while path:
            if (path, None) in held and vectors[path, None] != vectors[k]:
                return path
            path = path.rpartition("/")[0]
        return ""

    whole = lambda k: pages_of[k] >= 0.9 * n
    classes = {(tuple(vectors[k]), slot(k)) for k in held if k[1] is None and (whole(k) or pages_of[k] >= 3)}
    return {k for k in held if k[1] is not None and (whole(k) or (tuple(vectors[k]), slot(k)) in classes)}


def test_templates_of_the_test_pages_against_brute_force(spark):
    import re

    import pandas as pd

    pages = pd.read_parquet("/root/testdata/sf0.001/pages.parquet")  # whose hosts repeat no text, so one that does is added
    box = "<div class=box><p>Read more of this every week</p></div>"
    own = [f"<html><body><nav><a href=/>Home</a></nav><article><h1>Head {i}</h1><p>Text {i}</p>{box if i % 2 else ''}<p>End</p></article><p>Contact</p></body></html>" for i in range(12)]
    pages = pd.concat([pages, pd.DataFrame({"url": "http://own.example.org/", "html": own})])
    got = {r.host: set(r.template or ()) for r in template_extract.templates(
        spark.createDataFrame([((re.match(template_extract.HOST, u or "") or [None, ""])[1].lower(), i, h or "") for i, (u, h) in enumerate(zip(pages.url, pages.html))], "host string, page long, html string")
    ).collect()}
    hosts: dict[str, list[str]] = {}
    for u, h in zip(pages.url, pages.html):
        hosts.setdefault((re.match(template_extract.HOST, u or "") or [None, ""])[1].lower(), []).append(h or "")
    many = 0
    for host, some in hosts.items():
        want = {template_extract.piece(*k) for k in brute_template(some)} if len(some) > 1 else set()
        assert got.get(host, set()) == want, host
        many += len(want)
    assert many == 4
