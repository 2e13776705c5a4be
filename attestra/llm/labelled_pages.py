"""Labelled pages: whole small pages in which ``data-main`` marks the content, for layouts the given pages lack.

Fixed values: written for this library. An element with ``data-main="1"`` is
content with all it holds, one with ``data-main="0"`` is not; what is unmarked
follows its parent, and the page starts as not content.
"""

PAGES = [
    """<html><body><header class="site-header"><a href="/">Home</a><h2>The Paper</h2></header><nav class="menu"><ul><li><a href="/a">News</a></li>
<li><a href="/b">Sport</a></li></ul></nav><main><div class="post-content" data-main="1"><h1>Bridge opens after long repairs</h1><p>The bridge over the river opened
again on Monday, two years after the flood, and the first cars crossed it before noon.</p><p>Short one.</p><blockquote>It was time, said the mayor, and the town agreed.</blockquote>
<ul><li>Two lanes are open.</li><li>The third follows in spring.</li></ul><div class="share" data-main="0"><a href="/s">Share</a> <a href="/t">Send</a></div></div></main>
<aside class="sidebar"><h3>Related</h3><ul><li><a href="/x">Other stories of the week</a></li></ul></aside><section id="comments" class="comments"><h3>Comments</h3>
<div class="comment"><p>I crossed it this morning and the view is better than before, well done to all.</p></div><div class="comment"><p>Too late and too dear.</p></div></section>
<footer><p>Copyright The Paper. All rights reserved.</p></footer></body></html>""",
    """<html><body><div id="cookie-notice" class="notice banner"><p>We use cookies to make this site work. Read our policy and accept to go on.</p><button>Accept</button></div>
<div id="header"><div class="logo">Shop</div><form action="/search"><label>Search</label><input name="q"></form></div><div id="main"><div id="content" class="article" data-main="1">
<h1>How to keep bees</h1><h2>The hive</h2><p>A hive stands best where the morning sun reaches it and the wind does not. Turn its door to the south-east.</p>
<table><tr><th>Month</th><th>Work</th></tr><tr><td>April</td><td>Look for the queen.</td></tr></table><pre>feed = 2 * frames</pre><p>Leave honey for the winter.</p>
<div class="ad" data-main="0">Buy the best smoker today, half price.</div><p>Look in once a week, and never in the rain, for bees remember a bad visit.</p></div>
<div id="sidebar"><div class="widget"><h4>Newsletter</h4><form><input name="mail"><button>Join</button></form></div><div class="advert">Cheap wax here.</div></div></div>
<div id="footer"><ul><li><a href="/i">Imprint</a></li><li><a href="/p">Privacy</a></li></ul></div></body></html>""",
    """<html><body><nav><a href="/1">One</a><a href="/2">Two</a><a href="/3">Three</a></nav><article data-main="1"><h1>A word</h1><p>Yes.</p><section><h2>More</h2>
<p>The rest of the story is soon told: they came, they saw little, and they went home by the late train.</p><figure><figcaption>The station at night.</figcaption></figure></section>
<dl><dt>Train</dt><dd>A row of carriages.</dd></dl></article><div class="ads"><p>The quick way to learn a language, now with a free week for new readers of this page.</p></div>
<div class="related-posts"><h3>You may like</h3><p><a href="/4">Ten walks by the sea that you will want to take again and again</a></p></div><div class="comments-list"><article class="comment"><p>A fine story,
I read it twice and will tell my friends about it.</p></article></div><footer><div>Contact, imprint, help.</div></footer></body></html>""",
    """<html><body><div class="topbar"><span>Call us</span></div><div class="breadcrumb"><a href="/">Start</a> / <a href="/c">City</a></div><div class="wrapper"><div class="entry" data-main="1">
<div><p>In the old quarter the lamps are lit by hand, and a man with a ladder walks the streets at dusk, as his father did.</p></div><div>He takes two hours for it. Nobody has counted the lamps.</div>
<ol><li>First he fills the oil.</li><li>Then he trims the wick.</li></ol></div><div class="promo"><div>Subscribe now and save a third on the first year of the printed issue.</div></div></div>
<aside><p>Weather: dry and mild, later wind from the west with some rain in the hills.</p></aside><div role="alert" class="alert">This page is old.</div><footer class="foot"><small>Made with care.</small></footer></body></html>""",
    """<html><body><header><h1>My site</h1></header><section class="hero"><div class="signup"><form><p>Enter your address to hear from us every week.</p><input></form></div></section>
<section class="story" data-main="1"><h1>On walking</h1><p>Walk slowly. The path is older than the map, and the map has been wrong before.</p><p>Rest where others rested.</p><address>By the gate.</address></section>
<section class="discussion" id="replies"><h2>Replies</h2><div><p>This is so true, I walked there in May and the map was wrong indeed.</p></div></section><div class="social"><ul><li><a href="#">Follow</a></li></ul></div>
<footer>Since 1999.</footer></body></html>""",
    """<html><body><nav><a href="/">Start</a></nav><article data-main="1"><header><h1>The long walk home</h1></header><p>They set out before light, and by noon
they had passed the second lake and the hut where the road ends.</p><aside data-main="0"><p>Also read: the short walk, and how to pack for it.</p></aside><p>Nobody spoke.</p>
<form data-main="0"><p>Leave your address and we write to you once a month about walks.</p><input><button>Send</button></form><p>At the pass the wind met them, cold and full of sand,
and they lay down behind a wall until it dropped.</p><div class="notice" data-main="0">Some parts of this story are for members only, please sign in to read on.</div><p>Then they went on.</p>
<nav class="pager" data-main="0"><a href="/2">Next page</a></nav><section class="comments" data-main="0"><h3>Readers say</h3><p>I walked this way once and the hut was open then, with soup on the stove.</p>
<p>Nice.</p></section><footer data-main="0"><p>Filed under walks. Written in May.</p></footer></article><aside><h2>More</h2><p>The best maps of the year, seen and judged by our own people.</p></aside>
<footer>All rights reserved.</footer></body></html>""",
    """<html><body><header><p>Good news for the valley, every day since the war.</p><form><input></form></header><main data-main="1"><h1>New school</h1><p>The old school had four rooms and
one stove. The new one has twelve rooms, and in each of them it is warm.</p><div class="advertisement" data-main="0"><p>Shoes for small feet, now at the corner shop, two for one.</p></div>
<h2>Who paid</h2><ul><li>The town paid half.</li><li>The parents paid the rest.</li></ul><div class="related" data-main="0"><h4>See also</h4><ul><li><a href="/r">The old school sold</a></li></ul></div>
<p>It opens in autumn.</p><aside class="newsletter" data-main="0"><form><p>News by mail, every Friday, free.</p></form></aside><table><tr><td>Rooms</td><td>12</td></tr></table>
<div id="comments" data-main="0"><div class="comment"><p>Our children walk too far now, and the road has no light at all in winter.</p></div><form><p>Write a comment</p></form></div>
<footer data-main="0">Last changed on Monday.</footer></main><footer><nav><a href="/i">Imprint</a></nav></footer></body></html>""",
    """<html><body><article class="post" data-main="1"><h1>Bread</h1><p>Flour, water, salt, and time; the last is the one people leave out when they are in a hurry.</p><div class="cookie-banner" data-main="0"><p>This
page keeps small files on your machine, agree or leave.</p></div><blockquote>Wait.</blockquote><p>Bake it dark.</p><form class="search" data-main="0">Search recipes</form><div class="sidebar" data-main="0"><p>Ten
more breads that we bake each week of the year in our own oven.</p></div><section class="discussion" data-main="0"><p>Mine was flat, what did I do wrong?</p></section><div class="ad" data-main="0">Ovens.</div>
<footer class="tags" data-main="0">bread, salt</footer></article></body></html>""",
]
