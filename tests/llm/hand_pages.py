"""Pages written by hand, in layouts that the generator of training pages does not make, with the text that a reader would keep."""

PAGES = {
    "no optional tag at all": (
        "<!doctype html><title>Lakes</title><meta charset=utf-8><link rel=stylesheet href=s.css><nav><ul><li><a href=/>Home</a><li><a href=/a>About</a></ul></nav>"
        "<main><h1>On lakes</h1><p>Lakes are deep, and most of them are old.<p>They are cold, too, in early spring.<ul><li>Some freeze<li>Some do not</ul>"
        "<table><caption>Depths</caption><colgroup><col><col><thead><tr><th>Lake<th>Metres<tbody><tr><td>Baikal<td>1642<tr><td>Tanganyika<td>1470<tfoot><tr><td>Mean<td>1556</table>"
        "<dl><dt>Tarn<dd>A small lake in the hills<dt>Loch<dd>A Scottish one</dl><p>So much for lakes.</main><footer>Imprint",
        "On lakes Lakes are deep, and most of them are old. They are cold, too, in early spring. Some freeze Some do not Depths Lake Metres Baikal 1642 Tanganyika 1470 "
        "Mean 1556 Tarn A small lake in the hills Loch A Scottish one So much for lakes.",
    ),
    "head without its end": (
        "<!DOCTYPE html><html><head><title>T</title><meta charset=utf-8><body><article><h1>Head</h1><p>First paragraph of this page, which is long enough to be one.</p></article></body></html>",
        "Head First paragraph of this page, which is long enough to be one.",
    ),
    "head closed by an element": (
        "<html><head><title>T</title><script>var a = '<body>';</script><article><h1>Bread</h1><p>Flour, water, salt and a day of patience are all it needs.</p></article>",
        "Bread Flour, water, salt and a day of patience are all it needs.",
    ),
    "head closed by text": (
        "<html><head><title>T</title>\n<meta charset=utf-8>\nThe page begins with plain words, and goes on for a while in the same manner.",
        "The page begins with plain words, and goes on for a while in the same manner.",
    ),
    "aria-hidden within a paragraph": (
        "<body><article><h1>Energy</h1><p>The formula <span aria-hidden=\"true\">E = mc2</span> is known to most readers of this page.</p></article></body>",
        "Energy The formula E = mc2 is known to most readers of this page.",
    ),
    "aria-hidden first letter": (
        "<body><article><h1>Once</h1><p><span class=\"cap\" aria-hidden=\"true\">O</span>nce upon a time there was a king who had three daughters.</p></article></body>",
        "Once Once upon a time there was a king who had three daughters.",
    ),
    "ruby without end tags": (
        "<body><main><h1>漢字</h1><p><ruby>漢<rp>(<rt>kan<rp>)</ruby>の<ruby>字<rp>(<rt>ji<rp>)</ruby>を読みます。 毎日すこしずつ勉強しています。</p></main>",
        "漢字 漢(kan)の字(ji)を読みます。 毎日すこしずつ勉強しています。",
    ),
    "a shop's form with groups": (
        "<body><article><h1>Choosing a bicycle</h1><p>The frame must fit you before all else, said the dealer, and he was right.</p>"
        "<form><select><optgroup label=A><option>Red<option>Blue<optgroup label=B><option>Green</select><datalist><option>x</datalist><button>Buy</button></form>"
        "<p>Wheels come next.</p></article><footer><p>&copy; Bikes</p></footer></body>",
        "Choosing a bicycle The frame must fit you before all else, said the dealer, and he was right. Wheels come next.",
    ),
    "newspaper": (
        "<html><head><title>News</title></head><body><div id=\"masthead\"><a href=/>The Daily</a></div><ul class=\"nav-primary\"><li><a href=/w>World</a></li><li><a href=/s>Sport</a></li></ul>"
        "<div role=\"main\"><article class=\"story\"><h1>Bridge reopens after two years</h1><p>The old bridge over the river was opened to traffic again on Monday.</p>"
        "<div class=\"advertisement\">Advertisement: cheap flights to the south.</div><p>“It took far too long,” said the mayor; nobody disagreed.</p>"
        "<figure><img src=b.jpg><figcaption>The bridge on Monday morning.</figcaption></figure></article></div>"
        "<aside class=\"most-popular\"><h2>Most read</h2><ol><li><a href=1>One thing</a></li><li><a href=2>Another thing</a></li></ol></aside>"
        "<div class=\"site-footer\">Copyright The Daily. All rights reserved.</div></body></html>",
        "Bridge reopens after two years The old bridge over the river was opened to traffic again on Monday. “It took far too long,” said the mayor; nobody disagreed. The bridge on Monday morning.",
    ),
    "recipe": (
        "<body><nav><a href=/>Kitchen</a></nav><article itemprop=\"articleBody\"><h1>Lentil soup</h1><h2>You need</h2><ul><li>200 g of lentils<li>one onion<li>a litre of water</ul>"
        "<h2>How to cook it</h2><ol><li>Chop the onion and fry it in a little oil.<li>Add lentils and water.<li>Wait for half an hour.</ol></article>"
        "<section class=\"newsletter-signup\"><p>Get our best recipes every week.</p><form><input type=email><button>Sign up</button></form></section></body>",
        "Lentil soup You need 200 g of lentils one onion a litre of water How to cook it Chop the onion and fry it in a little oil. Add lentils and water. Wait for half an hour.",
    ),
    "documentation": (
        "<html><body><div class=\"sidebar-nav\"><ul><li><a href=a>Install</a></li><li><a href=b>Usage</a></li></ul></div><main id=\"content\"><h1>Usage</h1>"
        "<p>Call <code>run(&quot;x&quot;)</code> with the name of a task.</p><pre>run(\"x\")\n  .wait()</pre><p>It returns when the task is done.</p></main>"
        "<footer class=\"footer\"><a href=p>Previous</a> <a href=n>Next</a></footer></body></html>",
        'Usage Call run("x") with the name of a task. run("x") .wait() It returns when the task is done.',
    ),
    "quotation and definition": (
        "<body><article><h1>A word</h1><blockquote><p>To be is to do.</p><p>To do is to be.</p></blockquote><p>Nobody knows any more who wrote that first.</p>"
        "<dl><dt>Being</dt><dd>What is said to be.</dd></dl></article><div id=\"comments\"><h3>3 comments</h3><p>I know who it was, and I will not tell you.</p></div></body>",
        "A word To be is to do. To do is to be. Nobody knows any more who wrote that first. Being What is said to be.",
    ),
    "German with cookie notice": (
        "<html lang=de><head><title>Garten</title></head><body><div id=\"cookie-consent\"><p>Wir verwenden Cookies, um die Seite zu verbessern.</p><button>Gut</button></div>"
        "<header><a href=/>Gartenblatt</a><nav><a href=/b>Beete</a> <a href=/o>Obst</a></nav></header>"
        "<article><h1>Im M&auml;rz</h1><p>Jetzt werden die &Auml;pfelb&auml;ume geschnitten, bevor der Saft steigt.</p><p>Sp&auml;ter ist es zu sp&auml;t.</p></article></body></html>",
        "Im März Jetzt werden die Äpfelbäume geschnitten, bevor der Saft steigt. Später ist es zu spät.",
    ),
    "unclosed everything": (
        "<html><body><article><h1>Storm<p>The storm came in the night and took two roofs with it.<p>By morning <b>all was <i>quiet</b> again.<blockquote>It was loud, said one.",
        "Storm The storm came in the night and took two roofs with it. By morning all was quiet again. It was loud, said one.",
    ),
    "mismatched headings": (
        "<body><article><h1>Tea</h2><h2>Green</h3><p>Green tea is not fermented, so its leaves stay as they are.</p><h2>Black</h2><p>Black tea is fermented.</p></article></body>",
        "Tea Green Green tea is not fermented, so its leaves stay as they are. Black Black tea is fermented.",
    ),
    "odd attributes": (
        "<body><article><h1 title='a > b'>Signs</h1><p data-x=\"</p><script>\" class=hidden-gem>A sign may stand in a value, as the writer of this page has found.</p>"
        "<p title=it's>It may also be left open.</p><p style='display : none'>Not shown.</p><p hidden>Nor this.</p></article></body>",
        "Signs A sign may stand in a value, as the writer of this page has found. It may also be left open.",
    ),
    "script and comments in between": (
        "<body><article><h1>Pause</h1><p>One half of a sentence<!-- <p>cut --> and the other half.</p><script>document.write('<p>no</p>')</script><style>p{}</style>"
        "<template><p>no</p></template><p>The end comes after that, as it always does.</p></article></body>",
        "Pause One half of a sentence and the other half. The end comes after that, as it always does.",
    ),
    "blog with sharing and related posts": (
        "<body><div class=\"wrapper\"><div class=\"post\"><h1>Three days on foot</h1><div class=\"entry-content\"><p>We left the village at six and walked until noon.</p><p>The path was steep.</p></div>"
        "<div class=\"social-share\"><a href=#>Share</a> <a href=#>Tweet</a></div></div><div class=\"related-posts\"><h3>You may also like</h3><ul><li><a href=1>Two days by boat</a></li>"
        "<li><a href=2>A day by train</a></li></ul></div></div></body>",
        "Three days on foot We left the village at six and walked until noon. The path was steep.",
    ),
    "thread below a main": (
        "<body><main><h1>Clocks</h1><p>A clock that has stopped is right twice a day, and one that is slow never is.</p></main>"
        "<section class=\"discussion-thread\"><h2>Comments</h2><article><p>Mine runs backwards, so it is right four times.</p></article><article><p>Buy a new one.</p></article></section></body>",
        "Clocks A clock that has stopped is right twice a day, and one that is slow never is.",
    ),
    "drawing in the text": (
        "<body><article><h1>Circles</h1><p>The circle <svg width=20 height=20><circle r=5 /><text>r = 5</text></svg> is small enough for this page to hold.</p></article></body>",
        "Circles The circle r = 5 is small enough for this page to hold.",
    ),
    "nothing but boilerplate": (
        "<body><nav><ul><li><a href=/>Home</a></li><li><a href=/x>Shop</a></li></ul></nav><div class=\"cookie-banner\">We use cookies.</div><footer>&copy; 2020 Shop</footer></body>",
        "",
    ),
    "two heads and two bodies": (
        "<html><head><title>a</title></head><body><html><head><title>b</title></head><body><article><h1>Pasted</h1><p>One page was pasted into another, and both of them survived it.</p></article></body></html></body></html>",
        "Pasted One page was pasted into another, and both of them survived it.",
    ),
}
