"""Labelled pages for the weights of the content extractor: written for this library.

``CONTENT`` and ``/CONTENT`` comments mark the main text. The list is the whole
sample that the weights are fitted on; its size is fixed by what stands here.
"""

PAGES = (
    """<!DOCTYPE html><html><head><title>Harvest</title><style>p{margin:0}</style><script>go();</script></head><body>
    <header><a href="/">Valley Post</a><p>news from the valley every day</p></header>
    <nav><ul><li><a href="/a">home</a></li><li><a href="/b">markets</a></li><li><a href="/c">weather today</a></li></ul></nav>
    <div class="ad">buy two tractors and pay for one this month only</div>
    <article><!--CONTENT--><h1>Harvest begins early</h1><p>Farmers in the valley started to cut the wheat two weeks early,
    after a dry spring and a warm June.</p><p>The yield is <b>good</b> in most fields, said the union on <a href="/u">Monday</a>,
    and prices hold.</p><ul><li>wheat is up a tenth</li><li>barley is flat</li></ul><p>Rain is due next week.</p><!--/CONTENT--></article>
    <section class="comments"><h2>Comments</h2><p>great news for all of us here</p><p>my field looks poor this year</p></section>
    <footer>&copy; Valley Post &middot; contact us about anything at all</footer></body></html>""",
    """<html><body><div id="menu"><a href="/1">start</a> <a href="/2">archive</a> <a href="/3">about this site</a></div>
    <div class="content"><!--CONTENT--><h2>On sharpening</h2><p>A dull plane tears the grain. Hone the iron on a fine stone
    until the burr turns, then strop it.<br>Work slowly and keep the angle.</p><blockquote>Sharp is a habit, not an event.</blockquote>
    <p>Test the edge on end grain of pine.</p><!--/CONTENT--></div>
    <aside><h3>Popular</h3><ul><li><a href="/p">ten best chisels for beginners</a></li><li><a href="/q">which glue to use</a></li></ul></aside>
    <form><label>your mail</label><input name="m"><button>subscribe to letters</button></form>
    <div id="footer"><p>all words by the authors of this workshop diary</p></div></body></html>""",
    """<html><head><title>Lake</title></head><body><div class="cookie-notice"><p>we use cookies to make this site work well</p><button>accept</button></div>
    <nav><a href="/">index</a><a href="/m">maps</a><a href="/t">tours</a></nav>
    <main><!--CONTENT--><h1>The lake in winter</h1><p>From December the lake is frozen from shore to shore, and the ferry rests.</p>
    <table><tr><th>month</th><td>ice</td></tr><tr><th>January</th><td>thirty centimetres</td></tr></table>
    <p>People cross on skis. In March the ice turns grey and the crossing closes.</p><!--/CONTENT--></main>
    <div class="sidebar"><ul><li><a href="/x">hotels near the shore</a></li></ul></div>
    <footer><p>printed on recycled pixels by the tourist office</p></footer></body></html>""",
)

#: Further pages, for the weights of names in class, id and role: known names of boilerplate as they are
#: used in boilerplate, and as they are used on elements that hold the main text.
NAME_PAGES = PAGES + (
    """<html><body class="post has-sidebar"><div class="has-sidebar"><!--CONTENT--><h1>Bread</h1><p>Mix flour and water and
    let it rest for an hour before the salt goes in.</p><p>Fold the dough four times.</p><!--/CONTENT--></div>
    <div class="sidebar"><p>ten more loaves</p></div><div class="share buttons"><p>send this on</p></div></body></html>""",
    """<html><body><div class="with-sidebar"><!--CONTENT--><h1>Boats</h1><p>The hull is laid in spring and planked until
    the frost; a good builder has it tarred by then.</p><!--/CONTENT--></div><div class="sidebar-content"><p>boats for sale here</p></div>
    <div class="site-footer"><p>all rights are with the yard</p></div></body></html>""",
    """<html><body><div id="search-box"><p>find a page</p></div><div class="search-result" id="search-result-1"><!--CONTENT--><h2>Moss</h2>
    <p>Moss grows on the north side of stones where rain stays longest.</p><!--/CONTENT--></div>
    <div class="no-sidebar"><!--CONTENT--><p>It has no roots and drinks through its leaves.</p><!--/CONTENT--></div>
    <div class="comments-list"><p>lovely moss</p></div><div class="related-posts"><p>ferns and how they grow</p></div></body></html>""",
    """<html><body><div class="site-header"><p>the daily tide</p></div><div class="without-banner"><!--CONTENT--><p>High water comes
    at noon today, and the harbour gates stay open until two.</p><!--/CONTENT--></div><div class="banner"><p>sail with us</p></div>
    <div class="newsletter-box"><p>tides by mail</p></div><div class="cookie-banner"><p>we count visits</p></div></body></html>""",
    """<html><body><div class="menu"><p>start here</p></div><div class="has-banner"><!--CONTENT--><h1>Frost</h1><p>Frost forms on clear and
    still nights when the ground gives off its heat.</p><!--/CONTENT--></div><div class="has-menu"><!--CONTENT--><p>Cover the beds with straw
    before dusk.</p><!--/CONTENT--></div><div class="with-banner"><!--CONTENT--><p>Take the straw off by noon.</p><!--/CONTENT--></div>
    <div class="sidebar"><p>weather maps</p></div><div class="banner"><p>seeds by post</p></div><div class="search"><p>look for</p></div></body></html>""",
    """<html><body><div class="content no-comments"><!--CONTENT--><h1 class="page-header">Clay</h1><p>Clay is dug in autumn and left to
    the frost, which breaks it.</p><!--/CONTENT--></div><div class="comments"><p>good clay here</p></div>
    <div class="related-links-on post"><!--CONTENT--><p>In spring it is trodden and cut into loaves.</p><!--/CONTENT--></div>
    <div class="related links"><p>kilns and wheels</p></div><div class="no-ads content"><!--CONTENT--><p>A loaf rests until the wheel
    is free.</p><!--/CONTENT--></div><div class="ads"><p>glazes by the bucket</p></div></body></html>""",
)
