"""Pages written by hand in shapes that the training pages do not have: each line of a page is one block, those marked with + are content."""

import numpy as np

from foresail.llm import html_extract

PAGES = {
    "blog theme": """
<!doctype html><html lang=en><head><meta charset=utf-8><title>On bread</title><link rel=stylesheet href=a.css></head><body class="home single postid-12">
-<a class="skip-link screen-reader-text" href="#main">Skip to content</a><div id=page class=hfeed>
-<header id=masthead class=site-header><p class=site-title><a href=/>Crumbs and Crusts</a></p>
-<p class=site-description>A kitchen diary since 2009</p></header>
-<nav id=site-navigation class=main-navigation><ul><li><a href=/about>About</a></li>
-<li><a href=/recipes>Recipes</a></li></ul></nav><div id=content><main id=main><article id=post-12 class="post type-post hentry"><header class=entry-header>
+<h1 class=entry-title>Why the second loaf is better</h1></header><div class=entry-content>
+<p>Every baker knows the feeling: the first loaf comes out flat, and the second one rises.</p>
+<p>Flour needs time. When water has had a night to work, the dough is <em>stronger</em> than any kneading makes it.</p>
+<h2>What to change</h2>
+<ul><li>Use less yeast.</li>
+<li>Wait longer, and do not look.</li></ul>
+<blockquote><p>Bread is patience that you can eat.</p></blockquote></div></article></main></div>
-<aside id=secondary class=widget-area><section class="widget widget_recent_entries"><h2>Recent posts</h2>
-<ul><li><a href=/p/1>How to keep a starter</a></li></ul></section></aside>
-<div id=comments class=comments-area><h2 class=comments-title>2 thoughts</h2>
-<ol class=comment-list><li><div class=comment-body><p>I tried this on Sunday and it worked, thank you!</p></div></li></ol></div>
-<footer id=colophon class=site-footer>Proudly powered by flour</footer></div></body></html>""",
    "news site": """
<html><body><div class="top-banner ad-slot">-</div>
-<div class=global-nav><a href=/world>World</a> <a href=/money>Money</a> <a href=/sport>Sport</a></div><div class=page-wrap><div class="story-body">
+<h1 class=headline>Ferry returns to the northern islands</h1>
+<p class=lead>The first boat in eleven years left the harbour on Monday with forty passengers on board.</p><figure><img src=a.jpg>
+<figcaption>The ferry before it sailed.</figcaption></figure>
+<p>Residents had asked for the service since the old one closed. "We stopped counting the letters," said one of them.</p>
-<div class="ad-container"><p>Advertisement</p></div>
+<p>The council pays a third of the cost. A ticket is to stay below ten crowns until spring.</p>
-<div class=newsletter-signup><form><label>Get the morning briefing</label></form></div>
+<p>Whether it lasts will be decided in autumn, when the contract ends.</p></div>
-<div class=related-stories><h3>More on this</h3>
-<a href=/1>Bridge plan dropped after protests</a></div></div>
-<div class=social-share><a href=#>Share on social media</a></div>
-<div class=site-footer><p>&copy; 2024 The Northern Post. All rights reserved.</p></div></body></html>""",
    "manual": """
<html><body><div class=sphinxsidebar><h3>Table of contents</h3>
-<ul class=toctree><li><a href=#a>Install</a></li>
-<li><a href=#b>Configure</a></li></ul></div><div class=document><div class=body role=main><section id=a>
+<h1>Installing the agent</h1>
+<p>Unpack the archive and run the script in its folder.</p>
+<pre>sh install.sh --prefix=/opt/agent</pre>
+<p>It asks for a token. You find it on the page of your account.</p>
+<dl><dt>--quiet</dt>
+<dd>Print nothing unless something fails.</dd></dl></section></div></div>
-<div class=footer role=contentinfo>Last updated on 3 May.</div></body></html>""",
    "old tables": """
<HTML><BODY BGCOLOR=white><TABLE WIDTH=100%><TR><TD CLASS=menu><A HREF=index.htm>Home</A><BR><A HREF=links.htm>Links</A></TD><TD CLASS=text>
+<H1>The narrow gauge railway</H1>
+<P>The line was opened in 1898 to bring slate down to the coast, and it closed sixty years later.
+<P>Two engines survive. One stands in the museum, the other still runs on summer Sundays.
+<TABLE BORDER=1><TR><TD>Gauge</TD>
+<TD>597 mm</TD></TR></TABLE></TD></TR></TABLE>
-<DIV CLASS=copyright>Copyright 2001 by the Friends of the Line</DIV></BODY></HTML>""",
    "plain": """
+<h1>Notes on a small pond</h1>
+<p>The frogs came back in the second week of March, a little earlier than the year before.</p>
+<p>By April the water was full of spawn. Herons watched it from the far side.</p>""",
    "division soup": """
<body><div class=c-app><div class=c-cookie-consent><div>We use cookies to make this site work. <button>Accept</button></div>
-</div><div class=c-topbar><span>Menu</span></div><div class=c-article><div class=c-article__title>
+Learning to sail in a week</div><div class=c-article__body><div>
+The wind is never where you expect it, and that is the first thing you learn about it.</div><div>
+On the third day the boat did what I asked. On the fourth it did not, and I found out why.</div></div></div><div class=c-recommended><div>
-You may also like: ten knots for beginners</div></div><div class=c-footer><div>
-Terms and privacy</div></div></div></body>""",
    "German portal": """
<html lang=de><body><nav class=breadcrumb><a href=/>Start</a> &raquo; <a href=/garten>Garten</a></nav><main><article>
+<h1>Rosen im Herbst schneiden</h1>
+<p>Wer jetzt zur Schere greift, sollte nur die kranken Triebe entfernen. Alles andere hat Zeit bis zum Frühjahr.</p>
+<h3>Das richtige Werkzeug</h3>
+<p>Eine scharfe Schere schont die Pflanze. Nach jedem Strauch wird sie gereinigt.</p>
-<aside class=teaser-related><h4>Lesen Sie auch</h4></aside>
+<p>Zum Schluss bekommt der Boden eine Decke aus Laub.</p></article></main>
-<section class=kommentare id=comments><h2>Kommentare</h2>
-<p>Bei mir haben die Rosen den Schnitt im Herbst nie vertragen, schade.</p></section>
-<footer><a href=/impressum>Impressum</a></footer></body></html>""",
}


def judged(crf):
    """Over all pages: content found, found wrongly, and missed."""
    right = wrong = missed = 0
    for source in PAGES.values():
        page, want = [], []
        for line in source.strip().split("\n"):
            mark, rest = (line[0], line[1:]) if line[0] in "+-" else ("", line)
            page.append(rest)
            want += [(b.text, mark == "+") for b in html_extract.blocks(rest) if mark == "+"]
        found = [t for t in html_extract.main_text("\n".join(page), crf).split("\n") if t]
        keep = [t for t, _ in want]
        right += len(set(found) & set(keep))
        wrong += len(set(found) - set(keep))
        missed += len(set(keep) - set(found))
    return right, wrong, missed


def test_unseen_shapes():
    right, wrong, missed = judged(html_extract.trained())
    f1 = 2 * right / (2 * right + wrong + missed)
    print(f"content blocks found {right}, wrongly {wrong}, missed {missed}, F1 {f1:.3f}")
    assert f1 > 0.9


def test_left_out_holders():
    """Trained without any page of one shape of the article's holder, and judged on that shape alone."""
    pages = html_extract.labelled_pages(400)
    shape = lambda page: next((k for k, tag in enumerate(("<main", "<article", "<section")) if any(part[0].startswith(tag) and part[2] for part in page)), 3)
    for left_out in range(4):
        crf = html_extract.Field.fit(html_extract.examples([p for p in pages if shape(p) != left_out]), steps=80)
        held = html_extract.examples([p for p in pages if shape(p) == left_out])
        got = np.concatenate([crf.decode(x) for x, _ in held if len(x)])
        want = np.concatenate([y for x, y in held if len(x)])
        f1 = 2 * (got & want).sum() / (got.sum() + want.sum())
        print(f"shape {left_out}: {len(held)} pages, F1 {f1:.3f}")
        assert f1 > (0.7 if left_out == 3 else 0.95)  # without any page whose holder is a plain division, such pages are hard
