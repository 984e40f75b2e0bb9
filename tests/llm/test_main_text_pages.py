"""Reading of broken markup, and block F1 on pages labelled by hand in layouts that no generator here writes."""

import os
import re
import time

import duckdb
import pytest

from labspark.llm import html

TABLES = os.environ.get("LABSPARK_TEST_TABLES", "/root/testdata/sf0.001")


def texts(page):
    return [b[0] for b in html.leaf_blocks(page)]


def test_no_text_is_lost():
    assert texts("<article><p class=don't>Hello world one.</p><p>Second para isn't lost.</p><p>third</p></article>") == [
        "Hello world one.", "Second para isn't lost.", "third"]
    assert texts("The formula <math>x=2<annotation>x=2</annotation></math> holds") == ["The formula x=2 holds"]
    assert texts("<p>a <object data=x>fallback</object> and <canvas>drawing</canvas></p>") == ["a fallback and drawing"]
    assert texts("a < b <p>c</p> 1<2 </ x> <") == ["a < b", "c", "1<2 </ x> <"]
    assert texts("""<p title='a>b' data-x="it's">x</p><p a="b>y</p>z""") == ["x", "y", "z"]
    assert texts("<p>a<!-- x <p>b") == ["a"] and texts("<p>a<!-- x --><p>b<!DOCTYPE c><p>d") == ["a", "b", "d"]
    assert texts("<script src=x/>var a='<p>';</script><p>kept</p><svg/><p>too</p><svg><text>no</text></svg>") == ["kept", "too"]


@pytest.mark.parametrize("unit", ["<a href=\"x' y=\"> t ", "<a ", '<a b=">" ', "<div>t", "<div>t</p>", "<svg>x", "<!-- x ",
                                  "</div>x", "<div>t</i></b>", "<p class='x\">t", "<", "<p =", "&amp"])
def test_broken_pages_are_read_in_one_pass(unit):
    page = unit * (500_000 // len(unit))
    start = time.perf_counter()
    html.leaf_blocks(page)
    assert time.perf_counter() - start < 5


# "+" marks the blocks of the article; roles judged by hand
LABELLED = [
    ("<body><div id=top><a href=/>Daily Planet</a> <a href=/world>World</a> <a href=/sport>Sport</a></div><div class=story-body><h1>Bridge closes for repairs</h1><p>The old bridge over the river will close on Monday, the city said.</p><p>Work is expected to last until the spring.</p></div><div id=footer>Copyright 2019 Daily Planet</div></body>",
     ["Bridge closes for repairs", "The old bridge over the river will close on Monday, the city said.", "Work is expected to last until the spring."]),
    ("<main><nav aria-label=breadcrumb><ol><li><a href=/>Start</a></li><li><a href=/docs>Docs</a></li></ol></nav><h1>Installing the package</h1><p>Download the archive and unpack it.</p><ol><li>Open a shell in the folder.</li><li>Run the installer and wait for it to end.</li></ol><p>After that the command is on your path.</p></main><aside class=sidebar><h3>On this page</h3><ul><li><a href=#a>Installing</a></li></ul></aside>",
     ["Installing the package", "Download the archive and unpack it.", "Open a shell in the folder.", "Run the installer and wait for it to end.", "After that the command is on your path."]),
    ("<div class=page><div class=masthead><h2>Kitchen notes</h2></div><div class=post><h2>Plum cake</h2><p>Heat the oven. Beat the butter with the sugar until it is pale.</p><ul><li>200 g flour</li><li>3 eggs</li></ul><p>Bake for forty minutes.</p></div><div class=comments><h4>2 comments</h4><div class=comment><p>Lovely, I made it twice.</p></div><div class=comment><p>Can I use pears?</p></div></div></div>",
     ["Plum cake", "Heat the oven. Beat the butter with the sugar until it is pale.", "200 g flour", "3 eggs", "Bake for forty minutes."]),
    ("<header><div class=logo>Museum</div><nav><a href=/v>Visit</a><a href=/e>Exhibitions</a></nav></header><section class=cookie-banner><p>We use cookies to improve this site.</p><button>Accept</button></section><article><header><h1>A new wing opens</h1></header><p>Visitors can see the new wing from June onwards.</p><blockquote>It is the largest change in a century.</blockquote><p>Entry is free on the first day.</p></article><footer><p>&copy; The Museum</p></footer>",
     ["A new wing opens", "Visitors can see the new wing from June onwards.", "It is the largest change in a century.", "Entry is free on the first day."]),
    ("<body><form class=search><label>Search</label><input name=q></form><article><h1>Formelsammlung</h1><p>Die Formel <math>a^2+b^2=c^2</math> gilt im rechten Winkel.</p><div class=advertisement>Jetzt kaufen und sparen!</div><p>Der Beweis folgt aus der Ähnlichkeit der Dreiecke.</p></article><footer>Impressum</footer>",
     ["Formelsammlung", "Die Formel a^2+b^2=c^2 gilt im rechten Winkel.", "Der Beweis folgt aus der Ähnlichkeit der Dreiecke."]),
    ("<body><ul class=menu><li><a href=/1>Inicio</a></li><li><a href=/2>Noticias</a></li></ul><div class=content><h1>La feria vuelve al centro</h1><p>La feria del libro vuelve este año a la plaza mayor de la ciudad.</p><p>Habrá más de cien puestos.</p></div><div class=related><h3>Más noticias</h3><ul><li><a href=/3>El mercado cierra antes</a></li></ul></div></body>",
     ["La feria vuelve al centro", "La feria del libro vuelve este año a la plaza mayor de la ciudad.", "Habrá más de cien puestos."]),
    ("<body><article class=entry><h1>Notes on sorting</h1><p>Sorting by hand is slow.<p>A merge of two sorted lists takes one pass.<p>That is all there is to it.</article><div class=share><a href=x>Share</a> <a href=y>Mail</a></div><div class=newsletter><p>Subscribe to our newsletter</p><form><input><button>Go</button></form></div></body>",
     ["Notes on sorting", "Sorting by hand is slow.", "A merge of two sorted lists takes one pass.", "That is all there is to it."]),
    ("<body><nav><ul><li><a href=/>Accueil</a></li></ul></nav><main><article><h1>Le vent se lève</h1><p>Le vent souffle depuis hier sur la côte.</p><figure><img src=a><figcaption>La plage au matin.</figcaption></figure><p>Les bateaux restent au port.</p></article><section class=comments><h2>Commentaires</h2><p>Merci pour cet article.</p></section></main><footer>Mentions légales</footer></body>",
     ["Le vent se lève", "Le vent souffle depuis hier sur la côte.", "La plage au matin.", "Les bateaux restent au port."]),
    ("<table width=100%><tr><td class=nav><a href=a>Home</a><br><a href=b>Archive</a></td><td class=text><h1>Letter from the coast</h1><p>The ferry was late again, and nobody seemed to mind.</p><p>We walked up to the light house in the afternoon.</p></td></tr><tr><td class=footer>All rights reserved.</td></tr></table>",
     ["Letter from the coast", "The ferry was late again, and nobody seemed to mind.", "We walked up to the light house in the afternoon."]),
    ("<body><div role=banner>Town council</div><div role=navigation><a href=1>Meetings</a> <a href=2>Contact</a></div><div role=main><h1>Minutes of the meeting</h1><p>The meeting was opened at seven.</p><dl><dt>Present</dt><dd>Nine members and the clerk.</dd></dl><p>The next meeting is in May.</p></div><div role=contentinfo>Town hall, Main Street 1</div></body>",
     ["Minutes of the meeting", "The meeting was opened at seven.", "Present", "Nine members and the clerk.", "The next meeting is in May."]),
]


@pytest.fixture(scope="module")
def tagger():
    return html.fit(html.training_pages())


def test_block_f1_on_pages_labelled_by_hand(tagger):
    hits = found = wanted = 0
    for page, main in LABELLED:
        blocks = html.leaf_blocks(page)
        assert set(main) <= {b[0] for b in blocks}
        got = [b[0] for b, label in zip(blocks, tagger.labels(blocks), strict=True) if label]
        hits += len(set(got) & set(main))
        found += len(got)
        wanted += len(main)
    f1 = 2 * hits / (found + wanted)
    print(f"block F1 {f1:.3f}: {hits} of {wanted} found, {found - hits} too many")
    assert f1 > 0.9


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")
def test_pages_of_the_table(tagger):
    """These pages hold their text in one article, cut here by expressions that know nothing of blocks."""
    with duckdb.connect() as db:
        pages = db.execute(f"SELECT html FROM '{TABLES}/pages.parquet'").fetchall()
    for (page,) in pages:
        inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
        plain = [re.sub(r"\s+", " ", html.entities.unescape(re.sub(r"<[^>]+>", " ", part))).strip()
                 for part in re.split(r"</?(?:p|h1|h2|li|ul)>", inner)]
        assert tagger.extract(page)[0] == "\n\n".join(t for t in plain if t)
