"""The labelled table of the main-text extractor: texts as they stand on pages, put into pages of many layouts.

Every page is a list of (markup, label); a label of None opens or closes an element and holds no text. Each layout is given once with names and
elements that mark its parts, and once without any.
"""

from collections.abc import Iterator

# Example texts. Even places train the tree, odd ones are held out.
MENU = (
    "Home", "Start", "News", "About us", "Contact", "Sport", "Politics", "Politik", "Culture", "Kultur", "Business", "Wirtschaft", "Startseite", "Accueil",
    "Über uns", "À propos", "Kontakt", "Inicio", "Shop", "Noticias", "Login", "Register", "Search", "Archive", "Products", "Download", "Help", "Support", "Events", "Jobs",
)
NOTICE = (
    "Skip to content", "Skip to main navigation please", "Sign up today", "Read next", "Terms apply", "Share this page", "Subscribe to our newsletter", "Follow us", "Advertisement", "Anzeige",
    "We use cookies to improve your visit", "This website uses cookies", "Copyright 2024 Example Ltd", "© 2023 The Company. All rights reserved.", "All rights reserved",
    "Alle Rechte vorbehalten", "Diese Website verwendet Cookies, um Ihnen den besten Dienst zu bieten.", "Wir verwenden Cookies und ähnliche Techniken.", "Impressum und Datenschutz", "Datenschutz",
    "Tous droits réservés", "Ce site utilise des cookies pour améliorer votre visite.", "Todos los derechos reservados", "Este sitio usa cookies.", "Enter your email address", "Your name",
    "Log in to read more", "Please log in or register", "Back to top", "Print this page", "By using this site you accept our terms of use and our privacy policy.", "Please enable JavaScript to use all functions of this page.",
)
ADVERT = (
    "Buy one, get one free this week only", "The best phones at the lowest price", "Save 50 percent on all shoes", "Jetzt günstig bestellen und sparen", "Limited offer, order now and pay later", "Book your holiday by the sea today",
    "Nur heute: Versand ist kostenlos", "Win a new car in our great summer lottery", "Our new mattress lets you sleep like never before", "Livraison gratuite dès vingt euros",
)
ASIDE = (
    "The Daily Example has reported on the town and its people since 1921.", "Our author lives by the river and writes about gardens.", "Weather today: sunny, later some clouds, 21 degrees.",
    "Die Redaktion erreichen Sie montags bis freitags von neun bis siebzehn Uhr.", "Most popular this week in our shop", "About this blog: notes on cooking, travel and books.",
)
SITE = ("The Daily Example", "Example News", "Mein Blog", "Acme Corporation", "Garden and House", "La Gazette")
COMMENTS = ("Comments", "3 comments", "Reader comments", "Kommentare", "Leave a comment", "Commentaires", "Comentarios", "Responses")
COMMENT = (
    "Great article, thanks for sharing!", "I do not agree with the author at all.", "First!", "Merci pour cet article.", "Toller Beitrag, vielen Dank!", "Does anybody know where to find the old map?",
    "My grandmother lived there, so I know the place well and can say that it is all true, whatever others may write about it here.", "You forgot to mention the train station, which was built much later than the town hall, and by other people.",
    "Why is nobody talking about the money? We pay taxes every year, and in the end the streets look just as they did when I was a child.", "Ich wohne seit vierzig Jahren hier und habe so etwas noch nie gesehen, aber vielleicht wird ja doch noch alles gut. Danke an alle Helfer!",
)
TITLE = (
    "The bridge is open again", "How the old mill became a school", "A short history of tea", "Neue Schule am Fluss eröffnet", "Council votes for the new park", "What bees do in winter",
    "Le pont est de nouveau ouvert", "Ten rules for a quiet garden", "Tea", "Bees", "Neue Schule", "Der Fluss", "Quiet gardens", "On winter",
)
SENTENCE = (
    "The old bridge across the river was opened again on Monday after three years of work.", "Hundreds of people came to see the first bus cross it in the morning.",
    "The mayor said that the town had waited long enough for this day.", "Most of the stones are still the ones that masons cut four hundred years ago.",
    "Engineers had found deep cracks in two of the five arches.", "At first nobody knew whether the work could be paid for at all.", "In the end the state gave half of the money, and the town borrowed the rest.",
    "He agreed.", "Nothing came of it.", "It was too late.", "She laughed and went on.", "Bees do not sleep in winter; they form a ball around their queen and keep her warm.",
    "Each of them moves from the outside to the middle and back again, so that none gets too cold.", "A colony needs about twenty kilograms of honey to live until spring.",
    "Der Unterricht beginnt im neuen Gebäude nach den Ferien, wie die Leiterin am Freitag sagte.", "Die Kinder haben die Wände selbst gestrichen.", "Für die Bibliothek fehlen noch Bücher und Regale.",
    "Tea came to the country in the seventeenth century and was first sold as a medicine.", "Only the rich could pay for it, because the taxes were high.", "Smugglers brought more of it ashore than all honest traders together.",
    "Le conseil a voté pour le parc après un long débat qui a duré jusqu'à minuit.", "Les arbres seront plantés au printemps prochain.", "That changed when the tax was cut to a tenth.", "Why did it take so long?",
    "The school has rooms for two hundred children, a kitchen, and a garden in which they grow their own food.", "Parents had asked for it since the mill closed its doors.",
    "A garden is quiet when nothing in it has to be cut every week.", "Plant what grows there anyway, and leave the rest alone.", "Nobody was hurt.", "The work goes on.",
)


SHORT = (
    "He agreed.", "Nothing came of it.", "It was too late.", "She laughed.", "Nobody was hurt.", "The work goes on.", "Why?", "That was all.", "So they waited.", "Und dann?", "Niemand wusste es.", "C'est fini.", "No one came, and the day went by.", "It rained.",
)


class _Pool:
    """Texts of one half of the table, dealt one after the other."""

    def __init__(self, texts: tuple[str, ...], half: int):
        self.texts, self.at = texts[half::2], 0

    def __call__(self) -> str:
        self.at += 1
        return self.texts[(self.at * 7 + self.at // len(self.texts)) % len(self.texts)]


def _links(menu: _Pool, n: int, item: str) -> str:
    return "".join(item.format(f'<a href="/{i}">{menu()}</a>') for i in range(n))


def labelled_pages(half: int) -> Iterator[list[tuple[str, bool | None]]]:
    """The pages of one half (0: for training, 1: held out)."""
    menu, notice, advert, aside, site, comments, comment, title, sentence, short = (_Pool(t, half) for t in (MENU, NOTICE, ADVERT, ASIDE, SITE, COMMENTS, COMMENT, TITLE, SENTENCE, SHORT))

    def paragraph(n: int) -> str:
        return " ".join(sentence() for _ in range(n))

    def story(lengths, own: bool = False) -> list[tuple[str, bool | None]]:
        hold = "<div><p>{}</p></div>" if own else "<p>{}</p>"
        return [(hold.format(paragraph(n)), True) for n in lengths]

    lengths = ((3, 2, 4), (1, 3, 1, 2), (5, 6), (2,), (1, 1, 4, 1, 1, 3), (8, 1), (4,), (2, 2, 2, 2))
    for named in (True, False):
        tag = (lambda name, words="": (f"<{name}{words}>", f"</{name}>")) if named else (lambda name, words="": ("<div>", "</div>"))
        nav, head, foot, side, art, main = (tag(n) for n in ("nav", "header", "footer", "aside", "article", "main"))
        post, ad, cookie, talk = (tag("div", f" class='{w}'") for w in ("post-content", "advert", "cookie-notice", "comments"))
        for k, own in enumerate(lengths * 8):
            hold = (art, main, post)[k % 3] if named else ("<div>", "</div>") if k % 3 else ("", "")
            box = lambda pair, text, label=False: (pair[0] + text + pair[1], label)
            menu_items = (_links(menu, 3 + k % 4, "<li>{}</li>"), _links(menu, 2 + k % 5, "{} "), _links(menu, 4, "<p>{}</p>"))[k % 3]
            top = [box(nav, f"<ul>{menu_items}</ul>") if named or k % 2 else (f"<ul>{menu_items}</ul>", False)]
            if k % 4 == 0:
                top.insert(0, (f"<div>{notice()}</div>", False))
            if k % 4 == 1:
                top.insert(0, box(head, f"<h2>{site()}</h2>"))
            if k % 4 == 2:
                top.append((f"<p>{site()}</p>", False))
                top.append((f"<div>{_links(menu, 2, '{} | ')}</div>", False))
            if k % 4 == 3:
                top.append(box(cookie, f"<p>{notice()}</p>"))
            middle = [(hold[0], None), (f"<h1>{title()}</h1>", True), *story(own, own=k % 5 == 4)]
            if k % 2 == 0 and len(own) > 1:
                middle[3:3] = [(f"<p>{short()}</p>", True)] * (1 + k % 3 // 2)
            if k % 6 == 1:
                middle.insert(3, box(ad, advert()))
            if k % 6 == 2 and len(own) > 1:
                middle.insert(3, (f"<h2>{title()}</h2>", True))
            if k % 6 == 3:
                middle.append((f'<p>{sentence()} <a href="/x">{menu()}</a> {sentence()}</p>', True))
            if named and k % 2:
                middle += [(f"<p>{x}</p>", True) for x in ("x", notice(), f'<a href="/s">{menu()}</a>', comment())]  # what is marked belongs to it, whatever it is
            middle.append((hold[1], None))
            bottom = []
            if k % 3 == 0:
                said = [f"<p>{comment()}</p>" for _ in range(1 + k % 4)]
                if k % 2:
                    bottom += [(f"<h3>{comments()}</h3>", False), *[box(talk, c) for c in said]]
                else:
                    bottom.append(box(talk, f"<h3>{comments()}</h3>" + "".join(said)))
            if k % 3 == 1:
                bottom.append(box(side, f"<p>{aside()}</p>"))
                bottom.append((f"<div>{notice()}</div>", False))
            if k % 2 == 0:
                bottom.append(box(foot, f"<div>{_links(menu, 3, '{} ')}</div>"))
            if k % 5 == 3:
                bottom.append((f"<p>{notice()}</p>", False))
            if k % 5 == 2:
                bottom.append(box(ad, advert()))
            bottom.append(box(foot, notice()))
            if k % 7 == 6:
                bottom.append((f"<p>{notice()}</p>", False))
            if named:  # long texts beside the marked article, with and without marks of their own, and an advert as long within it
                long_ones = [(f"<div><p>{paragraph(1 + k % 3)}</p></div>", False), box(side, f"<p>{aside()} {aside()} {paragraph(k % 4)}</p>"), box(talk, f"<p>{comment()} {paragraph(1 + k % 2)}</p>")]
                top, bottom = [*top, *long_ones[k % 2 :: 2]], [*long_ones[(k + 1) % 2 :: 2], *bottom]
                middle.insert(-1, box(ad, f"{advert()} {paragraph(1 + k % 4)}"))
            yield top + middle + bottom
            if k % 4 == 3:  # a page that is all text
                yield story(own)
            if k % 4 == 2 and not named:  # columns of a table
                yield [("<table><tr><td>", None), *[(f"<p>{_links(menu, 1, '{}')}</p>", False) for _ in range(4)], ("</td><td>", None), (f"<h1>{title()}</h1>", True), *story(own), ("</td><td>", None), (f"<p>{aside()}</p>", False), ("</td></tr></table>", None)]
            if named:  # notices right before and behind the article, and wrappers named like a part of the page
                wrapper = ("content has-sidebar", "page with-header", "sidebar-layout", "wrap")[3 if k % 3 == 2 else k % 4]  # names alone don't tell a post from its wrapper
                yield [(f"<div class='{wrapper}'>", None), (f"<p>{site()}</p>", False), *middle, (f"<div>{notice()}</div>", False), (f"<p>{notice()}</p>", False), (f"<p>{aside()}</p>", False), ("</div>", None)]
