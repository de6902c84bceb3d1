"""Pages in the manner of common site designs, written by hand for the tests, and their main texts."""

PAGES = [
    # a weblog of a common publishing system
    (
        """<!DOCTYPE html><html lang="en"><head><meta charset="UTF-8"><title>On rivers | Field notes</title><link rel=stylesheet href=s.css></head>
<body class="post-template-default single single-post postid-52 logged-out">
<div id="page" class="hfeed site"><a class="skip-link screen-reader-text" href="#content">Skip to content</a>
<header id="masthead" class="site-header" role="banner"><div class="site-branding"><p class="site-title"><a href="/">Field notes</a></p><p class="site-description">Walks and waters</p></div>
<nav id="site-navigation" class="main-navigation"><ul id="primary-menu"><li><a href="/">Home</a></li><li><a href="/about">About</a></li></ul></nav></header>
<div id="content" class="site-content"><div id="primary" class="content-area"><main id="main" class="site-main" role="main">
<article id="post-52" class="post-52 post type-post hentry"><div class="entry-content"><h1>On rivers</h1><p>The river rose in the night and took the lower path with it.</p>
<p>By noon it had <em>fallen</em> again &mdash; as it always does in April.</p><blockquote><p>Never camp on sand.</p></blockquote></div></article>
<div id="comments" class="comments-area"><h2 class="comments-title">2 thoughts</h2><ol class="comment-list"><li class="comment"><p>I was there too, and it was higher in March than you say.</p></li></ol>
<div id="respond" class="comment-respond"><form action="/c" method="post"><label for="c">Comment</label><textarea id="c"></textarea><input type="submit"></form></div></div>
</main></div><aside id="secondary" class="widget-area" role="complementary"><section class="widget widget_recent_entries"><h2>Recent posts</h2><ul><li><a href="/a">On hills</a></li></ul></section></aside></div>
<footer id="colophon" class="site-footer"><div class="site-info">Proudly made by hand</div></footer></div><script>var x = "<p>no</p>";</script></body></html>""",
        ["On rivers", "The river rose in the night and took the lower path with it.", "By noon it had fallen again \u2014 as it always does in April.", "Never camp on sand."],
    ),
    # a newspaper
    (
        """<html><body><div class="cookie-banner" role="dialog"><p>This site uses cookies to improve your visit.</p><button>Accept</button></div>
<div class="topbar"><a href="/login">Log in</a> <a href="/subscribe">Subscribe</a></div>
<ul class="breadcrumb"><li><a href="/">News</a><li><a href="/city">City</a></ul>
<div class="story-body"><h1>Bridge reopens after nine months</h1><p>The old bridge opened to traffic on Monday, nine months after an inspection found cracks.</p>
<div class="ad-slot" id="ad-mid"><p>Cheap flights this weekend only</p></div>
<p>Engineers replaced forty beams.</p><p>The mayor called it <a href="/x">a good day</a> for the town.</p></div>
<div class="related-articles"><h3>Related</h3><ul><li><a href="/1">Ferry ends service</a></li><li><a href="/2">Toll plan dropped</a></li></ul></div>
<div class="newsletter-signup"><form><label>E-mail</label><input name=e><button>Sign up</button></form></div>
<div class="footer"><p>Imprint</p><p>All rights reserved</p></div></body></html>""",
        ["Bridge reopens after nine months", "The old bridge opened to traffic on Monday, nine months after an inspection found cracks.", "Engineers replaced forty beams.", "The mayor called it a good day for the town."],
    ),
    # documentation of a program
    (
        """<body><nav class="sidebar"><ul><li><a href=1>Install</a><li><a href=2>Use</a><li><a href=3>Options</a></ul></nav>
<main><section id="install"><h1>Install</h1><p>Unpack the archive and run the script in it.</p><pre>tar xf tool.tar
./tool/install</pre><ul><li>It needs ten megabytes.</li><li>It runs without a network.</li></ul></section></main>
<footer><p>Version 2</p></footer></body>""",
        ["Install", "Unpack the archive and run the script in it.", "tar xf tool.tar ./tool/install", "It needs ten megabytes.", "It runs without a network."],
    ),
    # an old page of tables and fonts, in capitals
    (
        """<HTML><BODY BGCOLOR=white><TABLE WIDTH=100%><TR><TD CLASS=menu><A HREF=a.htm>Home</A><BR><A HREF=b.htm>Links</A><BR><A HREF=c.htm>Guestbook</A></TD>
<TD CLASS=content><FONT SIZE=5>My garden in June</FONT><P>The beans came up at last, and the peas are in flower along the whole of the fence.<P>Slugs ate the lettuce.</TD></TR></TABLE></BODY></HTML>""",
        ["My garden in June", "The beans came up at last, and the peas are in flower along the whole of the fence.", "Slugs ate the lettuce."],
    ),
    # an application's generated class names
    (
        """<div id="root"><div class="css-1a2b"><header class="css-9z"><a href="/">Shop</a><nav><a href="/m">Men</a><a href="/w">Women</a></nav></header>
<article class="css-77q"><h1>How we tan leather</h1><p class="css-p1">Bark, water and a year of patience are all that the old way asks for.</p><p class="css-p1">We still do it so.</p></article>
<footer class="css-f0"><a href="/terms">Terms</a><a href="/privacy">Privacy</a></footer></div></div>""",
        ["How we tan leather", "Bark, water and a year of patience are all that the old way asks for.", "We still do it so."],
    ),
    # nothing but text
    ("<p>A note left on the table said only that they had gone to the sea.<p>It was not signed.", ["A note left on the table said only that they had gone to the sea.", "It was not signed."]),
]
