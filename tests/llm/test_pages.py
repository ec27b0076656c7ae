"""Main texts of hand-written pages of unlike make, and of the given pages, by the model as the query trains it."""

import html
import os
import re

import pytest

from quernel.llm import html_blocks

#: (name, page, main text)
PAGES = [
    ("bare divs", """<html><body><div class=menu><a href=/>Home</a> <a href=/blog>Blog</a> <a href=/about>About</a></div>
<div class=content><h1>A walk along the river</h1><div>We left the house early in the morning and took the path that leads down to the water.</div>
<div>The sun was not yet up, and the fields were white with frost.</div><div>By noon we had reached the old mill, where we had bread and cheese.</div></div>
<div class=footer>Copyright 2020 Some Site. All rights reserved.</div></body></html>""",
     "A walk along the river\nWe left the house early in the morning and took the path that leads down to the water.\nThe sun was not yet up, and the fields were white with frost.\nBy noon we had reached the old mill, where we had bread and cheese."),
    ("short list", """<body><nav><ul><li><a href=a>Recipes</a></li><li><a href=b>Contact</a></li></ul></nav><article><h1>Plain bread</h1>
<p>You need very little for a good loaf, and most of the work is waiting.</p><ul><li>500 g flour</li><li>10 g salt</li></ul>
<p>Mix everything with water and leave it under a cloth over night.</p></article><footer>&copy; The kitchen</footer></body>""",
     "Plain bread\nYou need very little for a good loaf, and most of the work is waiting.\n500 g flour\n10 g salt\nMix everything with water and leave it under a cloth over night."),
    ("table and list", """<html><head><title>Rivers</title></head><body><header><a href=/>Atlas</a><nav><a href=/m>Maps</a><a href=/c>Countries</a></nav></header>
<main><h1>Rivers of the north</h1><p>The rivers of the north are short and fast, and most of them freeze in winter.</p><h2>Lengths</h2>
<table><tr><th>Name</th><th>km</th></tr><tr><td>Tana</td><td>361</td></tr><tr><td>Kemi</td><td>550</td></tr></table>
<p>All of them are rich in salmon, which come up in early summer.</p><h2>Towns</h2><ul><li>Karasjok</li><li>Rovaniemi</li></ul></main>
<aside class=sidebar><h3>Most read</h3><ul><li><a href=1>Lakes of the south</a></li><li><a href=2>The highest peaks</a></li></ul></aside><footer>Imprint Privacy</footer></body></html>""",
     "Rivers of the north\nThe rivers of the north are short and fast, and most of them freeze in winter.\nLengths\nName\nkm\nTana\n361\nKemi\n550\nAll of them are rich in salmon, which come up in early summer.\nTowns\nKarasjok\nRovaniemi"),
    ("cookie bar and advert", """<body><div class="cookie-bar">We use cookies to give you the best experience. <button>Accept</button> <a href=/p>Settings</a></div>
<div class="ad-slot">Sponsored: buy two pairs of shoes and get one free, today only.</div>
<div class="post"><h1>Why the town hall clock stopped</h1><p>The clock on the town hall has stood still since Tuesday, and nobody seems to know why.</p>
<p>A spokesman for the council said that the works had been cleaned only last year.</p><p>The clock was built in 1887 and has been repaired four times since.</p>
<h2>A visit to the tower</h2><p>From the street one sees nothing unusual, but inside the tower it is strangely quiet.</p><p>The great wheel is covered with dust, and a bird has made its nest behind the bell.</p></div>
<div id=footer>Contact | Imprint | Privacy</div></body>""",
     "Why the town hall clock stopped\nThe clock on the town hall has stood still since Tuesday, and nobody seems to know why.\nA spokesman for the council said that the works had been cleaned only last year.\nThe clock was built in 1887 and has been repaired four times since.\nA visit to the tower\nFrom the street one sees nothing unusual, but inside the tower it is strangely quiet.\nThe great wheel is covered with dust, and a bird has made its nest behind the bell."),
    ("line breaks", """<html><body><div id="nav"><a href="/1">One</a> | <a href="/2">Two</a> | <a href="/3">Three</a></div><div id="text"><h2>Notes from the garden</h2>
The beans came up last week, and the first of them already reach for their poles.<br><br>Slugs are few this year because the spring was dry.<br><br>I will sow carrots as soon as the rain comes.</div><div id="bottom">Powered by a small machine in the cellar</div></body></html>""",
     "Notes from the garden\nThe beans came up last week, and the first of them already reach for their poles. Slugs are few this year because the spring was dry. I will sow carrots as soon as the rain comes."),
    ("definitions", """<body><nav><a href=/>Start</a><a href=/g>Glossary</a></nav><main><h1>Words of the printers</h1><p>Printers have words of their own, some of them centuries old.</p>
<dl><dt>Em</dt><dd>The width of a square of the type that is used.</dd><dt>Pie</dt><dd>Type that has been mixed up.</dd></dl></main><footer>&copy; 2019</footer></body>""",
     "Words of the printers\nPrinters have words of their own, some of them centuries old.\nEm\nThe width of a square of the type that is used.\nPie\nType that has been mixed up."),
    ("figure", """<body><header class="site-header"><a href="/">The Daily Herald</a></header><article><h1>Storm takes roof off church</h1><figure><img src="a.jpg"><figcaption>The church on Sunday morning.</figcaption></figure>
<p>A storm has taken the roof off the church of St. Mary, but nobody was hurt.</p><p>The mayor promised help and asked people to stay away from the building.</p></article>
<section class="related"><h3>Related articles</h3><ul><li><a href=1>Flood in the valley</a></li><li><a href=2>New bell for the church</a></li></ul></section><footer><p>Copyright The Daily Herald</p></footer></body>""",
     "Storm takes roof off church\nThe church on Sunday morning.\nA storm has taken the roof off the church of St. Mary, but nobody was hurt.\nThe mayor promised help and asked people to stay away from the building."),
    ("no names at all", """<html><body><div><a href=/>Home</a> <a href=/n>News</a> <a href=/s>Sport</a> <a href=/c>Culture</a></div><div><div><h1>The ferry runs again</h1><p>After three weeks of repairs the ferry is back on the lake.</p>
<p>Its engine, which had failed in the storm of early March, was replaced by a new one.</p><p>Tickets cost the same as before.</p></div></div><div><a href=/i>Imprint</a> <a href=/p>Privacy</a></div></body></html>""",
     "The ferry runs again\nAfter three weeks of repairs the ferry is back on the lake.\nIts engine, which had failed in the storm of early March, was replaced by a new one.\nTickets cost the same as before."),
    ("comments", """<body><article><h1>On keeping bees</h1><p>Keeping bees is easier than most people think, but it takes patience.</p><p>In the first year you will mostly watch and learn.</p></article>
<section id="comments"><h3>2 comments</h3><div class="comment"><p><b>Anna</b> said</p><p>I have kept bees for ten years and agree with every word of this.</p></div><div class="comment"><p><b>Tom</b> said</p><p>Thanks, great post!</p></div></section>
<form class="comment-form"><label>Your name</label><input><button>Send</button></form></body>""",
     "On keeping bees\nKeeping bees is easier than most people think, but it takes patience.\nIn the first year you will mostly watch and learn."),
    ("quotation and code", """<body><div class="navbar"><ul><li><a href=/d>Docs</a></li><li><a href=/api>API</a></li><li><a href=/f>Forum</a></li></ul></div><div class="entry-content"><h1>How to read a log</h1>
<p>Logs are read from the end, because the last lines tell what went wrong.</p><pre>error: no space left on device</pre><blockquote>Read the message first, then think.</blockquote><p>Only then look for the line before it.</p></div><footer>Docs are free</footer></body>""",
     "How to read a log\nLogs are read from the end, because the last lines tell what went wrong.\nerror: no space left on device\nRead the message first, then think.\nOnly then look for the line before it."),
    ("references", """<body><nav>Menu</nav><article><h1>Caf&eacute; &amp; bar</h1><p>The caf&#233; opens at   eight,
and the bar closes &#x61;t two &lt;sharp&gt;.</p><p>On Sundays both stay shut, as they always have.</p></article></body>""",
     "Café & bar\nThe café opens at eight, and the bar closes at two <sharp>.\nOn Sundays both stay shut, as they always have."),
    ("newsletter inside", """<body><nav><a href=/>Home</a></nav><article><h1>The price of milk</h1><p>Milk has become dearer for the third time this year, and farmers say it is still too cheap.</p>
<form class="newsletter"><p>Sign up for our newsletter</p><label>Email</label><input><button>Subscribe</button></form><p>Dairies answer that shops keep most of what customers pay.</p><p>A decision is expected in autumn.</p></article><footer>Terms Privacy Contact</footer></body>""",
     "The price of milk\nMilk has become dearer for the third time this year, and farmers say it is still too cheap.\nDairies answer that shops keep most of what customers pay.\nA decision is expected in autumn."),
    ("sections", """<body><header><nav><ul><li><a href=1>Overview</a></li><li><a href=2>Download</a></li></ul></nav></header><main><section><h1>The long way home</h1><p>This is a story in two parts, and the first is short.</p></section>
<section><h2>Part one</h2><p>He missed the train by a minute and decided to walk.</p></section><section><h2>Part two</h2><p>It took him nine days, and he has never taken a train since.</p></section></main><footer><a href=/l>Legal</a></footer></body>""",
     "The long way home\nThis is a story in two parts, and the first is short.\nPart one\nHe missed the train by a minute and decided to walk.\nPart two\nIt took him nine days, and he has never taken a train since."),
    ("sidebar of prose", """<body><div class="wrapper"><div class="main-content"><h1>Wolves return to the hills</h1><p>For the first time in a century wolves have been seen in the hills above the town.</p><p>Shepherds are worried, while biologists speak of a success.</p></div>
<div class="sidebar"><h3>About</h3><p>This site is written by volunteers who live in the region. You can support our work with a gift.</p><h3>Archive</h3><ul><li><a href=1>May</a></li><li><a href=2>April</a></li></ul></div></div><div class="footer">All rights reserved</div></body>""",
     "Wolves return to the hills\nFor the first time in a century wolves have been seen in the hills above the town.\nShepherds are worried, while biologists speak of a success."),
    ("scripts and styles", """<html><head><style>.x{color:red}</style><script>var a = "<p>not text</p>";</script></head><body><script>document.write("<div>neither</div>")</script><article><h1>Quiet days</h1><p>Nothing happened on Monday, and on Tuesday even less.</p><noscript>Please enable scripts</noscript><p>On Wednesday it rained a little in the evening.</p></article></body></html>""",
     "Quiet days\nNothing happened on Monday, and on Tuesday even less.\nOn Wednesday it rained a little in the evening."),
    ("unclosed paragraphs", """<body><ul class=nav><li><a href=1>Index<li><a href=2>Next</a></ul><div class=text><h1>Old ways of writing</h1><p>In the early days nobody closed a paragraph, and nobody missed it.<p>Browsers put up with everything, and so did their readers.<p>It is still allowed.</div><hr><address>webmaster</address></body>""",
     "Old ways of writing\nIn the early days nobody closed a paragraph, and nobody missed it.\nBrowsers put up with everything, and so did their readers.\nIt is still allowed."),
    ("german", """<body><nav><a href=/>Startseite</a><a href=/k>Kontakt</a></nav><article><h1>Der alte Garten</h1><p>Hinter dem Haus liegt ein Garten, den seit Jahren niemand mehr betreten hat.</p><p>Die Mauer ist hoch und mit Efeu bewachsen, und das Tor ist verschlossen.</p><h2>Der Schlüssel</h2><p>Der Schlüssel hängt im Flur, aber niemand weiß es.</p></article><footer>Impressum Datenschutz</footer></body>""",
     "Der alte Garten\nHinter dem Haus liegt ein Garten, den seit Jahren niemand mehr betreten hat.\nDie Mauer ist hoch und mit Efeu bewachsen, und das Tor ist verschlossen.\nDer Schlüssel\nDer Schlüssel hängt im Flur, aber niemand weiß es."),
    ("links inside", """<body><div id=menu><a href=a>Home</a><a href=b>Topics</a></div><div id=content><h1>A short history of tea</h1><p>Tea came to <a href=x>Europe</a> in the <a href=y>seventeenth century</a>, first as a medicine.</p><p>It was <em>very</em> expensive, and <b>merchants</b> kept it under lock and key.</p></div><div id=share>Share Tweet Print</div></body>""",
     "A short history of tea\nTea came to Europe in the seventeenth century, first as a medicine.\nIt was very expensive, and merchants kept it under lock and key."),
    ("ordered steps", """<body><nav><ul><li><a href=/>Home</a></li><li><a href=/h>Help</a></li></ul></nav><main><h1>How to change a tyre</h1><p>Changing a tyre takes half an hour if you have done it before.</p><ol><li>Loosen the nuts.</li><li>Lift the car.</li><li>Take the wheel off.</li><li>Put the spare wheel on and tighten the nuts.</li></ol><p>Drive slowly until the next garage.</p></main><aside class="ad">Buy now: winter tyres at half the price</aside></body>""",
     "How to change a tyre\nChanging a tyre takes half an hour if you have done it before.\nLoosen the nuts.\nLift the car.\nTake the wheel off.\nPut the spare wheel on and tighten the nuts.\nDrive slowly until the next garage."),
    ("deep wrappers", """<body><div class="page"><div class="container"><div class="row"><div class="col"><div class="breadcrumb"><a href=/>Home</a> / <a href=/n>Nature</a></div></div></div><div class="row"><div class="col"><div class="story"><h1>Fish of the deep sea</h1><div><p>Below a thousand metres there is no light but that which the fish make themselves.</p><p>Some carry lamps before their mouths, others along their sides.</p></div></div></div></div></div><div class="site-footer">Terms of use</div></div></body>""",
     "Fish of the deep sea\nBelow a thousand metres there is no light but that which the fish make themselves.\nSome carry lamps before their mouths, others along their sides."),
    ("one paragraph", """<body><nav><a href=1>Today</a><a href=2>Yesterday</a></nav><article><h1>Library closed</h1><p>The library stays closed on Friday.</p></article><footer>&copy; Town of Elm</footer></body>""",
     "Library closed\nThe library stays closed on Friday."),
    ("notice at the end", """<body><div class="topnav"><a href=/>Start</a><a href=/w>Weather</a></div><div class="article-body"><h1>Snow in April</h1><p>It has snowed in the night, and the children are out with their sledges.</p><p>The roads are clear, but buses run late.</p></div><div class="consent" role="dialog"><p>This site uses cookies. By continuing you accept our privacy policy.</p><button>Accept all</button></div></body>""",
     "Snow in April\nIt has snowed in the night, and the children are out with their sledges.\nThe roads are clear, but buses run late."),
]
FIXTURE = "/root/testdata/sf0.1/pages.parquet"


@pytest.fixture(scope="module")
def model():
    return html_blocks.labeller()


@pytest.mark.parametrize("name,page,text", PAGES, ids=[p[0] for p in PAGES])
def test_hand_written(model, name, page, text):
    assert html_blocks.main_texts([page], model)[0] == text


@pytest.mark.skipif(not os.path.isfile(FIXTURE), reason="no test tables")
def test_given_pages(model):
    """All given articles, whose blocks lie between the tags of one element."""
    import pyarrow.parquet as pq

    pages = pq.read_table(FIXTURE).column("html").to_pylist()
    wrong = 0
    for page, got in zip(pages, html_blocks.main_texts(pages, model)):
        article = re.search("(?s)<article>(.*?)</article>", page)[1]
        want = [" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", article)]
        wrong += got != "\n".join(w for w in want if w)
    assert wrong == 0
