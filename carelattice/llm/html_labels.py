"""The labelled table of text blocks that the extraction tree is trained on.

Each page is a list of (markup, label): 1 for a block of the article, 0 for any other block, None
for markup that holds no text of its own. The pages are written for this purpose.
"""

_LONG = (
    "The old harbour was dredged twice that winter, and each time the pilots had to learn the"
    " channel again before the first grain ships of the year could come in with the tide."
)
_LONGER = _LONG + " " + (
    "Nobody on the quay expected the work to be done by spring, least of all the engineer, who had"
    " seen three budgets come and go and kept the drawings of each in a drawer of their own."
)
_MID = "By noon the fog had lifted and the first boats went out past the mole."
_SHORT = "Then it rained."

LABELLED = [
    [
        ("<nav><ul><li><a href='/a'>News</a></li>", 0), ("<li><a href='/b'>Sport</a></li>", 0),
        ("<li><a href='/c'>Weather and tides</a></li></ul></nav>", 0),
        ("<div class='ad'>Ten percent off all rope this week only.</div>", 0),
        ("<article><h1>Harbour dredged again</h1>", 1), (f"<p>{_LONG}</p>", 1),
        (f"<p>{_SHORT}</p>", 1), (f"<p>{_LONGER}</p>", 1), (f"<p>{_MID}</p>", 1),
        ("<p>Yes.</p></article>", 1),
        ("<footer>&copy; The Quay Gazette. All rights reserved by the owners of it.</footer>", 0),
    ],
    [
        ("<header><h2>The Quay Gazette</h2>", 0), ("<p>Daily since the flood</p></header>", 0),
        ("<div class='cookie-notice'><p>We use cookies to count our readers and to show adverts"
         " that suit them better than others do.</p></div>", 0),
        ("<main><article><header><h1>Pilots learn channel</h1></header>", 1), (f"<p>{_MID}</p>", 1),
        (f"<p>{_LONG}</p>", 1),
        ("<div class='advert'><p>Buy two anchors and get the third one free of charge, only at the"
         " chandler's by the east gate until the end of the month.</p></div>", 0),
        (f"<p>{_SHORT}</p>", 1), (f"<blockquote>{_LONG}</blockquote>", 1),
        ("<ul><li>Two dredgers</li>", 1), ("<li>One tug</li></ul></article></main>", 1),
        ("<aside><h3>Most read</h3>", 0), ("<p><a href='/x'>Gulls take over the fish market</a></p>", 0),
        (f"<p>{_MID}</p></aside>", 0),
        ("<section class='comments'><h3>Comments</h3>", 0),
        (f"<div><p>{_MID} I was there and saw it all myself.</p></div>", 0),
        (f"<article><p>{_LONG}</p></article>", 0), ("<p>Same here.</p></section>", 0),
        ("<form><label>Your address</label>", 0),
        ("<p>Leave us your address and we write to you whenever the tide tables change.</p></form>", 0),
        ("<footer><p>Contact</p>", 0), (f"<p>{_MID}</p></footer>", 0),
    ],
    [   # nothing but plain elements: words and links have to tell
        ("<div><a href='/'>Home</a> <a href='/t'>Tides</a> <a href='/m'>Maps</a></div>", 0),
        ("<div><a href='/n'>Next story in this series about ports</a></div>", 0),
        ("<h1>Harbour dredged again after hard winter</h1>", 1), (f"<p>{_LONGER}</p>", 1),
        (f"<p>{_LONG}</p>", 1), (f"<p>{_SHORT}</p>", 1), (f"<p>{_LONGER}</p>", 1),
        (f"<p>{_MID}</p>", 1), (f"<p>{_LONG}</p>", 1),
        ("<div><a href='/1'>Older stories</a> | <a href='/2'>Newer stories</a></div>", 0),
        ("<div>Copyright Gazette</div>", 0), ("<div><a href='/i'>Imprint</a></div>", 0),
    ],
    [
        ("<div><a href='/'>Start</a></div>", 0), ("<div><a href='/all'>All ports</a></div>", 0),
        (f"<div>{_LONG}</div>", 1), (f"<div>{_LONGER}</div>", 1),
        (f"<div>{_LONG} <a href='/s'>See the map.</a></div>", 1), (f"<div>{_LONGER}</div>", 1),
        ("<div><a href='/p'>Print</a> <a href='/q'>Share</a></div>", 0),
        ("<div>Printed on paper</div>", 0),
    ],
    [
        ("<nav><a href='/z'>Home</a></nav>", 0), ("<article><h1>Rope and twine</h1>", 1),
        ("<p>Two of three.</p>", 1), ("<p><a href='/y'>Twine board</a></p>", 1),
        ("<p>It met twice.</p>", 1), ("<p><a href='/w'>Minutes</a></p>", 1),
        ("<p>Nobody came that day.</p>", 1), ("<p>Why?</p></article>", 1),
        ("<footer><p>Imprint</p></footer>", 0),
    ],
    [
        ("<ul><li><a href='/z'>Home</a></li>", 0), ("<li><a href='/y'>All ports</a></li></ul>", 0),
        ("<main><h2>Of rope</h2>", 1), ("<p>It was long.</p>", 1), (f"<p>{_LONG}</p></main>", 1),
        ("<div>Written for you</div>", 0), ("<div><a href='/v'>Mail</a></div>", 0),
        ("<div>Since the flood</div>", 0),
    ],
    [
        ("<article><h1>Rope</h1>", 1), ("<p>Short.</p>", 1), ("<p>Shorter still.</p>", 1),
        (f"<p>{_MID} <a href='/r'>More on rope</a></p>", 1),
        ("<p><a href='/src'>The full report of the board</a></p>", 1),
        (f"<nav><a href='/k'>{_MID}</a></nav>", 0), ("<p>End.</p></article>", 1),
    ],
]
