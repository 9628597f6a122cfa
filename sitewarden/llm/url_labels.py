"""The labelled urls that the url classifier learns from unless given a table of its own.

Public names that are commonly filtered or commonly kept, and made-up ones of the kind that junk
sites have, under the endings that these kinds use. None of them comes from a table to be judged."""

from __future__ import annotations

#: Gambling, adult, advertising and tracking, piracy, pill and prize sites.
BLOCK_HOSTS = """
pokerstars.com www.bet365.com betfair.com williamhill.com 888casino.com unibet.com bwin.com ladbrokes.com draftkings.com partypoker.com bovada.lv stake.com betway.com 1xbet.com leovegas.com paddypower.com
skybet.com ggpoker.com ignitioncasino.eu slotomania.com casinoguru-bonus.net royalslots.bet megajackpot.casino sportingbet.com luckyspins.win roulette77.club betonline.ag onlinepokies.bet
pornhub.com xvideos.com xnxx.com xhamster.com redtube.com youporn.com spankbang.com chaturbate.com brazzers.com livejasmin.com stripchat.com adultfriendfinder.com sexcams.tv hotmilfs.xxx nudeteens.xxx freepornvids.net
camgirls.live eroticstories.sex escortsnearme.com adultdating.club doubleclick.net googlesyndication.com adnxs.com taboola.com outbrain.com criteo.com popads.net propellerads.com adcolony.com scorecardresearch.com
quantserve.com rubiconproject.com pubmatic.com adroll.com exoclick.com trafficjunky.net adform.net adsrvr.org track.adclickz.com pixel.adtracker.io popunder.click adserver.bannerexchange.net
thepiratebay.org 1337x.to kickasstorrents.to yts.mx fmovies.to nulled.to crackedsoftware.net keygenguru.com warezforum.ws torrentz2.eu freeserials.ws
buyviagraonline.net canadianpharmacy24.com cialisgeneric.biz cheapmeds-rx.com pillsnoprescription.ru dietpills4u.biz winaniphone.click claimprize.top free-giftcards.xyz getrichquick.biz cryptodoubler.top
replicarolex.ru fakewatches.cn paypal-verify-login.tk bankaccount-update.ml paydayloans-fast.biz buybacklinks-seo.com
"""  # fmt: skip

#: Reference works, schools, offices, news, shops, code, health, sport; among them names that look like the others.
ALLOW_HOSTS = """
en.wikipedia.org de.wikipedia.org www.britannica.com archive.org gutenberg.org arxiv.org www.nature.com sciencedirect.com jstor.org plos.org
essex.ac.uk www.sussex.ac.uk ox.ac.uk mit.edu stanford.edu uni-heidelberg.de sorbonne-universite.fr unam.mx u-tokyo.ac.jp adult-education.wi.edu
whitehouse.gov www.nasa.gov nih.gov bundestag.de service-public.fr scunthorpe.gov.uk middlesex.gov.uk canada.ca europa.eu who.int
www.bbc.co.uk theguardian.com nytimes.com lemonde.fr spiegel.de elpais.com reuters.com apnews.com corriere.it aljazeera.com
github.com gitlab.com stackoverflow.com docs.python.org pypi.org kernel.org www.gnu.org apache.org rust-lang.org freebsd.org
clickhouse.com adobe.com addgene.org adidas.com spamhaus.org trackandfieldnews.com fasttrack-training.org betterhealth.vic.gov.au bettercotton.org alphabet.org
bannerhealth.com starspangledbanner.org pharmacytimes.com medlineplus.gov mayoclinic.org nhs.uk redcross.org cancer.org adultliteracyleague.org adulted-council.ca
amazon.com ebay.co.uk ikea.com zalando.de decathlon.fr walmart.com etsy.com patagonia.com lego.com hobbycraft.co.uk
imdb.com rottentomatoes.com spotify.com goodreads.com allrecipes.com seriouseats.com tripadvisor.com lonelyplanet.com booking.com airbnb.com
fifa.com espn.com olympics.com uefa.com chess.com weather.com openstreetmap.org nationalgeographic.com smithsonianmag.com khanacademy.org
"""  # fmt: skip

#: Stems that say what a site is for, and words that say nothing: joined by a rule, each stem with several.
BLOCK_STEMS = ("casino", "poker", "slots", "bet", "jackpot", "bingo", "lotto", "roulette", "blackjack", "porn", "xxx", "adult", "sexy", "nude", "cams", "escort", "erotic", "viagra", "cialis", "pills", "rxmeds", "keygen", "crack", "warez", "torrent", "adserver", "ads", "tracker", "popunder", "clickads", "spam", "linkfarm", "backlinks", "prize", "payday", "replica", "phishing")
ALLOW_STEMS = ("garden", "school", "river", "music", "travel", "news", "kitchen", "science", "history", "health", "sport", "photo", "bike", "coffee", "design", "law", "hotel", "art", "code", "data", "cloud", "map", "book", "city", "farm", "club", "family", "green", "wood", "doctor", "museum", "library", "weather", "forum", "wiki", "docs", "shop")
FILLERS = ("online", "world", "zone", "king", "best", "my", "live", "hub", "24", "pro", "the", "one", "star", "top", "net", "point", "house", "time")

#: Paths of either kind of page. `{}` is a number.
PLAIN_PATHS = ("/", "", "/about", "/contact", "/index.html", "/en/{}", "/blog/{}", "/news/2021/{}", "/item/{}", "/p/{}", "/help/faq", "/login", "/search", "/category/home", "/user/{}")
BLOCK_PATHS = ("/casino/free-spins", "/bonus/jackpot", "/slots/play-now", "/live-sex/{}", "/videos/xxx-{}", "/buy/cheap-viagra", "/pills/order", "/crack/keygen-{}", "/torrent/download-{}", "/ads/click/{}", "/pixel/track", "/banner/{}/click", "/claim-prize/{}", "/verify-account", "/betting/odds")
ALLOW_PATHS = ("/wiki/Casino", "/research/papers/{}", "/library/guide", "/history/rivers", "/recipes/bread-{}", "/docs/install", "/news/lottery-law-{}", "/health/side-effects", "/sports/football/{}", "/travel/italy", "/issues/{}", "/weather/today", "/courses/math-{}", "/science/physics", "/music/concerts")


def background_hosts(n: int = 300) -> list[str]:
    """Hosts of no known kind: pronounceable names by a rule, two to four open or closed syllables
    under common endings. They count as ordinary, so that letters alone convict nobody."""
    state, out = 12345, []

    def draw(choices: str | tuple[str, ...]) -> str:
        nonlocal state
        state = (state * 6364136223846793005 + 1442695040888963407) % 2**64
        return choices[(state >> 33) % len(choices)]

    while len(out) < n:
        name = "".join(draw("bcdfghjklmnprstvwyz") + draw(("", "", "", "h", "r", "l")) + draw("aeiou") + draw(("", "", "n", "r", "s", "t", "l", "nd", "st")) for _ in range(int(draw("234"))))
        out.append(draw(("", "", "www.", "blog.", "m.", "shop.")) + name + draw((".com", ".com", ".net", ".org", ".de", ".fr", ".co.uk", ".info", ".io")))
    return out


def stem_hosts(stems: tuple[str, ...], each: int = 4) -> list[str]:
    """Every stem with `each` fillers before or behind it, with and without a hyphen."""
    out = []
    for i, stem in enumerate(stems):
        for k in range(each):
            pair = (stem, FILLERS[(i * 5 + k * 7) % len(FILLERS)])
            out.append(("", "www.", "m.", "blog.")[(i + k) % 4] + ("-" if (i + k) % 3 == 0 else "").join(pair if k % 2 else pair[::-1]) + (".com", ".net", ".org", ".info", ".de")[(i + 2 * k) % 5])
    return out


def labelled_hosts() -> list[tuple[str, str]]:
    """(host, "block" or "allow")."""
    kinds = (("block", BLOCK_HOSTS.split() + stem_hosts(BLOCK_STEMS)), ("allow", ALLOW_HOSTS.split() + stem_hosts(ALLOW_STEMS) + background_hosts()))
    return [(h, v) for v, hosts in kinds for h in sorted(hosts)]


def labelled_paths(verdict: str) -> tuple[str, ...]:
    """The paths that a kind's urls have: those of its own and plain ones, in turn."""
    own = BLOCK_PATHS if verdict == "block" else ALLOW_PATHS
    return tuple(p for pair in zip(PLAIN_PATHS, own) for p in pair)


def labelled_urls(each: int = 4) -> list[tuple[str, str]]:
    """(url, "block" or "allow"): every host alone and with `each` paths in turn, half of them plain."""
    out = []
    for h, (host, verdict) in enumerate(labelled_hosts()):
        paths = labelled_paths(verdict)
        out.append((f"https://{host}/", verdict))
        out += [(f"http://{host}{paths[(h * 7 + k * 11) % len(paths)].format((h * 389 + k * 1277) % 9973)}", verdict) for k in range(each)]
    return out
