"""Pages labelled by hand, in layouts that training never sees: (html, the blocks of the main text)."""

BLOG = """<!doctype html><html><head><title>On pruning</title><style>.x{}</style></head><body class="home single"><div id="page" class="site">
<a class="skip-link" href="#content">Skip to content</a>
<header id="masthead" class="site-header"><div class="site-branding"><p class="site-title"><a href="/">The Orchard Diary</a></p><p class="site-description">Notes from a small orchard</p></div>
<nav id="site-navigation" class="main-navigation"><button class="menu-toggle">Menu</button><ul id="primary-menu"><li><a href="/about">About</a></li><li><a href="/archive">Archive</a></li><li><a href="/contact">Contact</a></li></ul></nav></header>
<div id="content" class="site-content"><main id="main"><article id="post-12" class="post hentry"><header class="entry-header"><h1 class="entry-title">When to prune an old apple tree</h1></header>
<div class="entry-content"><p>Most old trees are pruned too hard and too early. A tree that has not been touched for ten years will answer a hard cut with a forest of water shoots.</p>
<p>I take out the dead wood first, and only then look at the shape. Nothing else needs to happen in the first winter.</p><h2>What to cut in the second year</h2>
<ul><li>Branches that rub against each other.</li><li>Shoots that grow into the middle of the crown.</li></ul><blockquote><p>A pruned tree should look as if nobody had been there.</p></blockquote><p>In the third year the tree usually bears again.</p></div></article>
<section id="comments" class="comments-area"><h2 class="comments-title">3 thoughts on this post</h2><ol class="comment-list"><li class="comment"><div class="comment-author">Marta says:</div><p>Thank you, I ruined two trees before I read this.</p></li><li class="comment"><div class="comment-author">Jon says:</div><p>What about pears? Mine never bear at all.</p></li></ol>
<form class="comment-form"><label>Name</label><input><label>Comment</label><textarea>Write here</textarea><button>Post comment</button></form></section></main></div>
<aside id="secondary" class="widget-area"><section class="widget widget_recent_entries"><h2>Recent posts</h2><ul><li><a href="/1">Grafting knives compared</a></li><li><a href="/2">A mild January</a></li></ul></section></aside>
<footer id="colophon" class="site-footer"><p>Proudly powered by an old laptop. &copy; 2019</p></footer></div></body></html>"""
BLOG_TEXT = [
    "When to prune an old apple tree",
    "Most old trees are pruned too hard and too early. A tree that has not been touched for ten years will answer a hard cut with a forest of water shoots.",
    "I take out the dead wood first, and only then look at the shape. Nothing else needs to happen in the first winter.",
    "What to cut in the second year", "Branches that rub against each other.", "Shoots that grow into the middle of the crown.",
    "A pruned tree should look as if nobody had been there.", "In the third year the tree usually bears again.",
]

NEWS = """<html><head><title>Bridge</title><script>window.dataLayer=[];</script></head><body><div id="cookie-consent" class="consent-overlay"><p>We and our partners store cookies on your device to show you personal offers.</p><button>Accept all</button><button>Settings</button></div>
<header class="top"><a href="/">Harbour Times</a><form class="search"><input><button>Search</button></form></header><nav class="sections"><a href="/w">World</a> <a href="/b">Business</a> <a href="/s">Sport</a> <a href="/c">Culture</a></nav>
<div class="leaderboard ad-slot"><span>Advertisement</span></div><div class="layout"><main class="story"><h1>Bridge closes for two months while its cables are replaced</h1><p class="lede">The old suspension bridge will be closed to all traffic from Monday, the port authority said on Friday.</p>
<div class="story-body"><p>Engineers found broken wires in four of the sixteen main cables during an inspection in spring. The bridge had been limited to light vehicles since then.</p><div class="inline-ad"><p>Sponsored: Save up to forty percent on winter tyres today.</p></div><p>Ferries will run every ten minutes until midnight. Cyclists travel free, a spokesman said.</p>
<div class="newsletter-signup"><h3>Get the morning briefing</h3><form><input placeholder="Email"><button>Sign up</button></form></div><p>The work is expected to cost eleven million and to last until the end of November.</p><p>A new bridge, planned since 2004, has not been decided on.</p></div></main>
<aside class="right-rail"><h4>Most read</h4><ol><li><a href="/a">Fog delays flights for a third day</a></li><li><a href="/b">Market hall sold to a chain</a></li><li><a href="/c">Why the herring is back</a></li></ol></aside></div>
<section class="related"><h3>More on this story</h3><ul><li><a href="/d">How the cables were made in 1931</a></li></ul></section><footer><ul><li><a href="/imprint">Imprint</a></li><li><a href="/privacy">Privacy</a></li></ul><p>&copy; Harbour Times Ltd. All rights reserved.</p></footer></body></html>"""
NEWS_TEXT = [
    "Bridge closes for two months while its cables are replaced",
    "The old suspension bridge will be closed to all traffic from Monday, the port authority said on Friday.",
    "Engineers found broken wires in four of the sixteen main cables during an inspection in spring. The bridge had been limited to light vehicles since then.",
    "Ferries will run every ten minutes until midnight. Cyclists travel free, a spokesman said.",
    "The work is expected to cost eleven million and to last until the end of November.",
    "A new bridge, planned since 2004, has not been decided on.",
]

DOCS = """<html><body><div class="related" role="navigation"><ul><li><a href="genindex">index</a></li><li><a href="next">next</a></li><li><a href="prev">previous</a></li></ul></div>
<div class="sphinxsidebar" role="navigation"><h3>Table of contents</h3><ul><li><a href="#a">Installation</a></li><li><a href="#b">First steps</a></li><li><a href="#c">Reference</a></li></ul><form class="search"><input><button>Go</button></form></div>
<div class="document"><div class="body" role="main"><section id="first-steps"><h1>First steps</h1><p>This chapter shows how a table is made, filled and read. It takes about ten minutes.</p><p>Start the shell and type the following line:</p><pre>table = store.create("fruit", columns=["name", "weight"])</pre><p>The call returns an empty table. Rows are added one at a time or many at once.</p>
<table><tr><th>Method</th><th>Meaning</th></tr><tr><td>add</td><td>adds one row</td></tr><tr><td>extend</td><td>adds many rows</td></tr></table><p>Errors are reported when the table is closed, not before.</p></section></div></div>
<div class="footer">&copy; Copyright 2021, the authors. Last updated on May 3. Created with a documentation tool.</div></body></html>"""
DOCS_TEXT = [
    "First steps", "This chapter shows how a table is made, filled and read. It takes about ten minutes.", "Start the shell and type the following line:",
    'table = store.create("fruit", columns=["name", "weight"])', "The call returns an empty table. Rows are added one at a time or many at once.",
    "Method", "Meaning", "add", "adds one row", "extend", "adds many rows", "Errors are reported when the table is closed, not before.",
]

RECIPE = """<html><body><div class="top-bar"><div class="logo"><a href="/">Kitchen table</a></div><ul class="menu"><li><a href="/r">Recipes</a></li><li><a href="/s">Seasons</a></li><li><a href="/l">Log in</a></li></ul></div>
<div class="container"><div class="col-main"><div class="recipe post-content"><h1>Barley soup with mushrooms</h1><p>A soup for cold evenings that is better on the second day than on the first. It needs an hour, most of it without you.</p><h2>Ingredients</h2><ul><li>200 g pearl barley</li><li>400 g brown mushrooms, sliced</li><li>1 large onion, chopped</li></ul>
<div class="adsbox"><a href="/ad">Order this pan now with free delivery</a></div><h2>Method</h2><ol><li>Fry the onion slowly until it is golden, about ten minutes.</li><li>Add the mushrooms and let their water boil away.</li><li>Stir in the barley, cover with stock and simmer for forty minutes.</li></ol><p>Serve with sour cream and plenty of dill.</p></div>
<div class="share-buttons"><a href="#">Share</a><a href="#">Tweet</a><a href="#">Pin it</a></div><div id="disqus_thread" class="discussion"><h3>Join the discussion</h3><div class="reply"><b>Ana</b><p>Made this yesterday, my children asked for more!</p></div><div class="reply"><b>Per</b><p>Too much dill for my taste, but good.</p></div></div></div>
<div class="col-side sidebar"><h4>You may also like</h4><a href="/x">Lentils with bacon</a><a href="/y">Potato bread</a></div></div><div id="footer" class="footer"><p>Contact us | Terms of use | Privacy policy</p></div></body></html>"""
RECIPE_TEXT = [
    "Barley soup with mushrooms", "A soup for cold evenings that is better on the second day than on the first. It needs an hour, most of it without you.",
    "Ingredients", "200 g pearl barley", "400 g brown mushrooms, sliced", "1 large onion, chopped", "Method",
    "Fry the onion slowly until it is golden, about ten minutes.", "Add the mushrooms and let their water boil away.",
    "Stir in the barley, cover with stock and simmer for forty minutes.", "Serve with sour cream and plenty of dill.",
]

PLAIN = """<html><body><div><a href="/">Start</a> <a href="/texte">Texte</a> <a href="/bilder">Bilder</a> <a href="/kontakt">Kontakt</a></div>
<div><h1>Der Weg über den Pass</h1><p>Im Frühjahr ist der Pass noch lange gesperrt. Erst wenn der Schnee von den Südhängen gerutscht ist, gehen die ersten Wanderer hinauf.</p><p>Der alte Saumpfad beginnt hinter der Kirche und steigt in vielen Kehren durch den Wald. Oben steht eine kleine Hütte, deren Tür nie verschlossen ist.</p>
<p>Wer dort übernachtet, hört in der Nacht die Steine fallen. Am Morgen ist der See spiegelglatt, und man sieht bis zu den Gletschern im Westen.</p><p>Der Abstieg auf der anderen Seite ist kürzer, aber steil. Für Kinder ist er nicht geeignet.</p></div><div>&copy; 2008 Impressum Datenschutz</div></body></html>"""
PLAIN_TEXT = [
    "Der Weg über den Pass",
    "Im Frühjahr ist der Pass noch lange gesperrt. Erst wenn der Schnee von den Südhängen gerutscht ist, gehen die ersten Wanderer hinauf.",
    "Der alte Saumpfad beginnt hinter der Kirche und steigt in vielen Kehren durch den Wald. Oben steht eine kleine Hütte, deren Tür nie verschlossen ist.",
    "Wer dort übernachtet, hört in der Nacht die Steine fallen. Am Morgen ist der See spiegelglatt, und man sieht bis zu den Gletschern im Westen.",
    "Der Abstieg auf der anderen Seite ist kürzer, aber steil. Für Kinder ist er nicht geeignet.",
]

TABLES = """<html><body><table width="100%"><tr><td colspan="2" class="header"><h1>Village of Stonebrook</h1></td></tr><tr><td class="menu" width="150"><a href="/">Home</a><br><a href="/h">History</a><br><a href="/m">Map</a><br><a href="/g">Guestbook</a></td>
<td class="content"><h2>History of the mill</h2><p>The mill was built in 1742 by two brothers who had come from the coast. For a hundred years it ground the corn of five villages.</p><p>After the flood of 1855 the wheel was moved to the other bank. The old foundations can still be seen when the water is low.</p><p>It stopped working in 1931, and has been a school, a workshop and a dance hall since then.</p></td></tr>
<tr><td colspan="2" class="footer">Webmaster: webmaster@stonebrook.example. Best viewed at 800 x 600.</td></tr></table></body></html>"""
TABLES_TEXT = [
    "History of the mill", "The mill was built in 1742 by two brothers who had come from the coast. For a hundred years it ground the corn of five villages.",
    "After the flood of 1855 the wheel was moved to the other bank. The old foundations can still be seen when the water is low.",
    "It stopped working in 1931, and has been a school, a workshop and a dance hall since then.",
]

MAGAZINE = """<html lang="es"><body><div class="aviso-cookies"><p>Usamos cookies propias y de terceros.</p><a href="#">Aceptar</a></div><div id="cabecera"><a href="/">La Gaceta del Valle</a><div class="buscador"><input><button>Buscar</button></div></div>
<div id="menu"><a href="/p">Portada</a> | <a href="/d">Deportes</a> | <a href="/o">Opinión</a></div><div id="contenido"><h1>El mercado vuelve a la plaza mayor</h1><p>Después de doce años en las afueras, el mercado de los sábados regresa al centro del pueblo. La primera edición será en mayo.</p>
<p>Los vendedores pidieron el cambio en una carta firmada por casi todos. El ayuntamiento tardó dos años en contestar.</p><h2>Cuarenta puestos</h2><p>Habrá cuarenta puestos de fruta, queso, pan y flores. Los coches no podrán entrar antes de las tres de la tarde.</p><ol><li>Fruta y verdura, junto a la fuente.</li><li>Queso y pan, bajo los soportales.</li></ol></div>
<div id="lateral"><h3>Lo más leído</h3><a href="/1">Cierra el cine</a><a href="/2">Nieve en abril</a></div><div id="comentarios"><h3>2 comentarios</h3><p>Pepe: ¡Por fin!</p><p>Lola: ¿Y dónde aparco yo ahora?</p></div><div id="pie"><p>Aviso legal. Todos los derechos reservados.</p></div></body></html>"""
MAGAZINE_TEXT = [
    "El mercado vuelve a la plaza mayor", "Después de doce años en las afueras, el mercado de los sábados regresa al centro del pueblo. La primera edición será en mayo.",
    "Los vendedores pidieron el cambio en una carta firmada por casi todos. El ayuntamiento tardó dos años en contestar.", "Cuarenta puestos",
    "Habrá cuarenta puestos de fruta, queso, pan y flores. Los coches no podrán entrar antes de las tres de la tarde.",
    "Fruta y verdura, junto a la fuente.", "Queso y pan, bajo los soportales.",
]

CHANGES = """<html><body><nav class="navbar"><a class="brand" href="/">toolkit</a><ul><li><a href="/docs">Docs</a></li><li><a href="/blog">Blog</a></li></ul></nav><section class="hero banner"><p>Version 4 is out. Read the announcement.</p></section>
<main><div class="prose"><h1>Release notes for 3.2</h1><p>This release is about speed. Reading large files takes a third of the time it took before, and needs no more memory than a small one.</p><h2>Added</h2><ul><li>A reader for compressed files.</li><li>Progress is reported on the standard error.</li><li>Two new commands, merge and split.</li></ul><h2>Fixed</h2><ul><li>A crash on empty input.</li><li>Wrong line numbers in messages after a blank line.</li></ul>
<h2>Removed</h2><p>The old names of the options, which had been announced two years ago, are gone.</p></div></main><aside class="toc"><a href="#added">Added</a><a href="#fixed">Fixed</a></aside><div class="subscribe-box"><form><label>Stay up to date</label><input><button>Subscribe</button></form></div><footer class="site-foot"><a href="/terms">Terms</a><span>Made with care since 2011</span></footer></body></html>"""
CHANGES_TEXT = [
    "Release notes for 3.2", "This release is about speed. Reading large files takes a third of the time it took before, and needs no more memory than a small one.",
    "Added", "A reader for compressed files.", "Progress is reported on the standard error.", "Two new commands, merge and split.", "Fixed", "A crash on empty input.",
    "Wrong line numbers in messages after a blank line.", "Removed", "The old names of the options, which had been announced two years ago, are gone.",
]

PAGES = {"blog": (BLOG, BLOG_TEXT), "news": (NEWS, NEWS_TEXT), "docs": (DOCS, DOCS_TEXT), "recipe": (RECIPE, RECIPE_TEXT), "plain": (PLAIN, PLAIN_TEXT), "tables": (TABLES, TABLES_TEXT)}
#: Written before training was widened for what the pages above had shown, and not looked at in that.
UNSEEN = {"magazine": (MAGAZINE, MAGAZINE_TEXT), "changes": (CHANGES, CHANGES_TEXT)}
