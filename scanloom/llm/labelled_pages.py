"""Pages labelled by hand that the extraction model is trained on.

An element's ``data-y`` says whether it and what lies below it is main content (1) or not (0), until another one says so.
"""

PAGES = (
    # A news story.
    """<html data-y="0"><head><title>News</title></head><body><header class="site-header"><a href="/">Daily</a>
    <form class="search" action="/s"><input name="q"><button>Search</button></form></header>
    <nav class="main-nav" role="navigation"><ul class="menu"><li><a href="/a">World</a></li><li><a href="/b">Sport</a></li></ul></nav>
    <div class="cookie-notice notice">We use cookies. <button>Accept</button></div>
    <main><article class="story" data-y="1"><h1>Harbour reopens after storm</h1><p>The harbour reopened on Monday, two weeks
    after the storm had damaged its <a href="/pier">northern pier</a>.</p><p>Engineers said the work took longer than planned,
    as parts had to be shipped from abroad.</p><blockquote><p>We are glad it is over.</p></blockquote>
    <h2>What is next</h2><ul><li>New lights along the pier</li><li>A second crane</li></ul>
    <div class="ad advert" data-y="0">Buy cheap boats today!</div>
    <aside class="related" data-y="0"><h3>Related</h3><ul><li><a href="/1">Storm</a></li><li><a href="/2">Pier</a></li></ul></aside>
    </article></main><section class="comments" id="comments"><h3>Comments</h3><div class="comment"><p>I was there when it happened,
    and it was quite a sight to behold for all of us.</p></div><div class="comment"><p>Great news for the whole town, I think.</p></div>
    <form><textarea></textarea><button>Post comment</button></form></section>
    <footer class="site-footer"><p>Copyright Daily. All rights reserved. Contact us by mail.</p></footer></body></html>""",
    # A blog entry without sectioning elements.
    """<html data-y="0"><body><div id="header" class="header banner"><h1><a href="/">My blog</a></h1><p>Notes on gardening</p></div>
    <div id="wrapper" class="container"><div id="content" class="post entry" data-y="1"><h2>Pruning roses</h2>
    <div class="entry-content"><p>Roses are pruned in <b>early spring</b>, before the buds break.<br>Use a sharp blade.</p>
    <p>Cut above an outward facing bud, at an angle, and remove all dead wood from the plant.</p><pre>spring: hard, summer: light</pre>
    <table><tr><th>Kind</th><th>Month</th></tr><tr><td>Tea rose</td><td>March</td></tr></table>
    <div class="share social" data-y="0"><a href="#">Share</a> <a href="#">Tweet</a></div></div></div>
    <div id="sidebar" class="sidebar widget"><h3>Archive</h3><ul><li><a href="/05">May</a></li><li><a href="/06">June</a></li></ul>
    <div class="newsletter subscribe"><p>Subscribe to our letter and never miss a post again.</p><form><input></form></div>
    <div class="advertisement ads sponsored"><p>Sponsored: the best shears on the market, now at half the price.</p></div></div></div>
    <div id="respond" class="comment-respond comments-area"><ol class="comment-list"><li class="comment"><p>Thanks, that helped me a
    lot with my old roses last year.</p></li><li class="comment"><p>What about climbing roses?</p></li></ol></div>
    <div id="footer" class="footer"><p>Powered by a blog engine. Privacy policy. Imprint.</p></div></body></html>""",
    # A manual page.
    """<html data-y="0"><body><div class="topbar navbar"><a href="/">Home</a><a href="/docs">Docs</a></div>
    <div class="breadcrumb breadcrumbs"><a href="/">Home</a> / <a href="/docs">Docs</a> / Install</div>
    <aside class="toc sidebar"><ul><li><a href="#a">Before</a></li><li><a href="#b">After</a></li></ul></aside>
    <div class="alert warning notice banner"><p>This site will be down for maintenance on Sunday.</p></div>
    <main id="main" role="main" data-y="1"><section><h1>Install</h1><p>Unpack the archive and run the script in it.</p>
    <p>On a server, add the folder to the path first.</p><code>run me</code></section><section class="text"><h2>Options</h2><dl><dt>-q</dt>
    <dd>Be quiet.</dd></dl><figure><img src="x.png"><figcaption>The main window</figcaption></figure></section></main>
    <div class="pagination pager"><a href="/1">Previous</a><a href="/3">Next</a></div>
    <footer role="contentinfo"><ul class="links"><li><a href="/imprint">Imprint</a></li><li><a href="/terms">Terms</a></li></ul></footer></body></html>""",
    # Plain text in the body, with popups around it.
    """<html data-y="0"><body><div class="popup modal overlay" id="consent"><p>Please agree to our use of your data.</p><button>OK</button></div>
    <p data-y="1">This page has no structure at all, but its text is what readers come for.</p><p data-y="1">It goes on for a second
    paragraph that says a little more.</p><p data-y="1">And a third.</p><form class="login"><label>Name</label><input><button>Sign in</button></form>
    <menu><li><a href="/x">Back</a></li></menu></body></html>""",
    # A shop's article in a language with accents.
    """<html data-y="0"><body><header><nav><ul><li><a href="/a">Início</a></li><li><a href="/b">Loja</a></li></ul></nav><h2>Loja</h2></header>
    <div class="promo banner ad-slot"><a href="/p">Promoção</a></div><section class="article-body content" data-y="1"><h1>Café</h1>
    <p>O café é torrado <em>todas as semanas</em> e moído na hora, com cuidado.</p><p><span>Guarde-o</span> num lugar seco.</p></section>
    <section class="reviews discussion comments"><article class="comment review"><p>Muito bom, recomendo a todos os meus amigos.</p></article>
    <article class="comment review"><p>Chegou depressa e bem embalado, obrigado.</p></article></section>
    <aside><h4>Também</h4><p>Outros produtos que podem interessar a quem comprou este.</p></aside><footer><p>Contato e ajuda</p><div class="social">
    <a href="#">Seguir</a></div></footer></body></html>""",
    # A short item between adverts.
    """<html data-y="0"><body><nav><ul><li><a href="/1">One</a></li><li><a href="/2">Two</a></li><li><a href="/3">Three</a></li></ul></nav>
    <div class="ad">The best offers of the week.</div><article data-y="1"><h1>Notice to readers</h1><p>Our office stays closed in May.</p>
    </article><div class="ad ads">More offers for you.</div><footer>All rights reserved. Follow us.</footer></body></html>""",
    # A forum-like page whose article has sections of its own header and footer.
    """<html data-y="0"><body><header id="top"><p>Welcome, guest. Please sign in or register.</p></header><div class="page"><article class="post" data-y="1">
    <header data-y="0"><p class="meta byline">By A. Writer, 4 May</p></header><div class="body"><p>Long walks are good for you, say those who take them,
    and they ought to know.</p><p>Take water with you.</p><ol><li>Start early.</li><li>Rest at noon.</li></ol></div>
    <footer class="tags" data-y="0"><a href="/t/walk">walk</a> <a href="/t/health">health</a></footer></article>
    <div class="replies responses comments"><p>Readers say</p><blockquote class="reply"><p>I walk each day and could not agree more with this.</p></blockquote></div>
    <aside class="promo newsletter"><p>Join ten thousand readers and get our letter.</p></aside></div><div class="disclaimer legal copyright">No warranty.</div></body></html>""",
    # Two pages of a plain site.
    """<html data-y="0"><body><header><a href="/">Site</a></header><div class="sidebar"><h4>Latest</h4><p>What happened this week.</p></div>
    <article data-y="1"><h1>Title</h1><p>First paragraph of the article.</p><p>Second paragraph, with a <a href="/x">reference</a>.</p>
    <div class="notice" data-y="0"><p>Cookies make this site work.</p></div><form data-y="0"><p>Your opinion</p></form><h3>Part</h3><p>Third.</p></article>
    <div class="comments"><h3>Comments</h3><p>Well said.</p><p>I do not agree at all.</p></div><footer><p>Imprint</p></footer></body></html>""",
    """<html data-y="0"><body><nav><a href="/">Home</a></nav><div class="ad">Buy</div><div id="page"><article data-y="1"><h1>Other title</h1>
    <p>Only one paragraph.</p><section class="comments" data-y="0"><div class="comment"><h4>Reader</h4><p>Nice.</p></div></section></article></div>
    <section id="comments" class="comments"><h2>Comments</h2><div class="comment"><p>First!</p></div><div class="comment"><p>Second.</p></div></section>
    <div class="sidebar notice"><p>News in brief.</p></div><footer><div>Copyright</div></footer></body></html>""",
    """<html data-y="0"><body><div class="menu"><ul><li>Home</li><li>About</li></ul></div><div class="banner">Sale</div><div class="article" data-y="1"><h2>Third title</h2>
    <div>Text in a plain block.</div><p>Text in a paragraph.</p><ul><li>An item of it</li><li>Another</li></ul></div><div class="footer">End</div></body></html>""",
    # Plain blocks without names.
    """<html data-y="0"><body><div><div class="header">Menu</div><div data-y="1"><p>Here the text begins.</p><p>Here it goes on.</p></div></div></body></html>""",
    """<html data-y="0"><body><div class="top">Welcome</div><div data-y="1"><h1>Heading</h1><p>Text.</p><p>More text.</p></div><div class="footer">End</div></body></html>""",
    """<html data-y="0"><body><div><h2 data-y="1">Heading</h2><p data-y="1">Text.</p></div><div class="promo">Offer</div></body></html>""",
    # Pages that name nothing: what a block is shows by its text, its links and where it stands.
    """<html data-y="0"><body><div><a href="/">Start</a> <a href="/b">Books</a> <a href="/m">Maps</a></div><div data-y="1"><h1>The old mill</h1>
    <p>The mill by the river was built four hundred years ago, and for most of that time it ground the corn of the whole valley.</p>
    <p>Its wheel was taken out when the railway came. The building itself still stands, and is now a school for carpenters.</p></div>
    <div>Open daily</div></body></html>""",
    """<html data-y="0"><body><div><div><ul><li><a href="/1">First</a></li><li><a href="/2">Second</a></li></ul></div><div data-y="1"><div><h2>On bread</h2>
    <p>Good bread needs flour, water, salt and above all time, which is the one thing that bakers in a hurry do not have.</p></div><div>
    <p>Let the dough rest overnight in a cool place. In the morning it will have doubled, and you can shape it on a board.</p></div></div></div></body></html>""",
    """<html data-y="0"><body><main><div data-y="1"><h1>Night trains</h1><p>Night trains are running again between the large cities, after years in which one
    after another was cut from the timetable.</p><p>Most of them are sold out weeks ahead.</p></div></main></body></html>""",
    """<html data-y="0"><body><section data-y="1"><h1>Snow in April</h1><p>It snowed for three days, and the roads over the pass were closed to all traffic.</p>
    <p>Farmers fear for the blossom of their trees, which had begun to open a week before.</p></section><section><h3>More</h3><ul><li><a href="/x">Rain
    in May</a></li><li><a href="/y">Wind in June</a></li></ul></section></body></html>""",
    """<html data-y="0"><body><table><tr><td><a href="/a">Home</a><br><a href="/b">News</a><br><a href="/c">Links</a></td><td data-y="1"><h1>Keeping bees</h1>
    <p>A hive should face the morning sun, and stand where no wind from the north can reach it.</p><p>Look at the bees once a week, and write down what you
    see. After a year you will know what is usual.</p></td></tr></table></body></html>""",
    """<html data-y="0"><body><div id="q7"><div id="q8"><a href="/">Index</a> <a href="/z">Search</a></div><div id="q9" data-y="1">
    <h1>Tides</h1>The sea rises and falls twice a day, because the moon pulls at the water on the near side more than at the earth itself.
    <p>The sun does the same, but less. When both pull in one line the tides are highest, and we call them spring tides.</p></div></div></body></html>""",
    """<html data-y="0"><body><div data-y="1">The letter came on a Friday. Nobody had expected it, and for a whole day it lay unopened on the table in the hall.<br>On
    Saturday the youngest of the children read it out, and then there was a long silence.</div></body></html>""",
    """<html data-y="0"><body><header><h2>The Courier</h2><nav><a href="/1">City</a><a href="/2">Land</a></nav></header><div data-y="1"><h1>Bridge to be rebuilt</h1>
    <p>The council decided on Tuesday to rebuild the old bridge, which has been closed to lorries since the flood of last autumn.</p>
    <p>Work is to begin in spring.</p><ul><li>Two lanes for cars</li><li>One path for cyclists</li></ul></div><div><a href="/p">Older</a> <a href="/n">Newer</a>
    </div><footer>All rights reserved.</footer></body></html>""",
    """<html data-y="0"><body><div><div><div><a href="/in">Sign in</a></div></div><div><div data-y="1"><h1>A short history of glass</h1></div><div data-y="1"><p>Glass was
    first made by chance, they say, by sailors who cooked on a beach and used blocks of soda to hold their pots over the fire.</p></div></div></div></body></html>""",
)
