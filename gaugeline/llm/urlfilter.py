"""URL filters: rules by host and path, then logistic regression on hashed character n-grams.

The model is trained on the driver from a small labelled table of URLs (TABLE, or a parameter);
its weights are one fixed-size vector.  n-grams of the host (with its ends marked) and of the path's
words have separate hash spaces.  The table has written hosts of both classes, with ordinary ones that share parts of
their names with unwanted ones, and words that unwanted, ordinary and well-known sites are called by, under many domains,
all with paths of either kind; it has more ordinary names, so that hosts unlike any of it are allowed.

Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased.  Path: from there up to `?`,
`#` or the end.  A rule (host, path, verdict) fits its host and all subdomains where the path starts
with the rule's; the longest rule wins (longest host and path together, then host, then the text).

Defined cases: a null URL or one without `://` has an empty host and path, fits no rule and is
allowed; repeated rows get equal results; an empty table gives an empty result; extra columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
SIZE = 1 << 16

#: Words that names of unwanted sites are made of, first and second halves.
LURES = "cheap free best win online hot big fast lucky easy buy get super real instant secret".split()
WARES = "casino poker slots betting jackpot roulette bingo-bonus pills viagra cialis pharmacy meds steroids loans payday credit-repair quick-cash crypto-profit bitcoin-doubler forex-signals xxx porn sex-chat sexdating webcams nude-pics hot-girls escorts adult-dating adult-video replica-watches fake-rolex designer-replica torrents cracked-games keygen serial-crack warez spyware phishing malware popup-ads ads-server ad-tracker click-track click-bait traffic-exchange link-farm spam-links spam-mailer seo-backlinks buy-followers buy-likes prize-draw lottery-winner gift-cards giftcard-generator weight-loss diet-miracle miracle-cure money-maker get-rich essay-writers".split()
#: Words that names of ordinary sites are made of.
PLACES = "river green city north old open east blue central little silver maple harbor village national union summit valley first modern".split()
THINGS = "news library university museum garden science history weather recipes travel school council hospital books theatre music forum stories archive research bank market kitchen software engineering football railway cinema church gallery energy insurance motors airlines hotels coffee bakery academy institute society press radio television data maps photos jobs law design studio health sports games shop docs wiki blog mail cloud video search security labs parts tools foods farm homes clinic dental legal media writing knitting sailing printing building planning fishing gardening swimming rating listing wedding meeting".split()
#: Names in the ways that well-known sites are called.
KNOWN = "wikipedia github stackoverflow nytimes guardian reuters bbc adobe apache python mozilla kernel debian nature sciencedirect springer arxiv archive gutenberg imdb spotify netflix amazon microsoft apple google youtube linkedin reddit twitter facebook instagram pinterest tumblr medium quora yahoo bing wordpress blogger ebay etsy walmart target ikea airbnb booking tripadvisor expedia lufthansa siemens bosch volkswagen renault toyota samsung sony nintendo harvard stanford berkeley oxford cambridge sorbonne ethz nasa noaa usgs europa bundestag gov.uk loc smithsonian metmuseum louvre spiegel lemonde elpais corriere asahi".split()
#: Hosts of unwanted sites, in the variety that they have: adult, gambling, piracy, advertising and tracking, pills, phishing (of brands in
#: subdomains, too), money, prizes, copies of brands, bought papers.
UNWANTED = """xnxx.com xhamster.com youporn.com spankbang.com brazzers.com chaturbate.com livejasmin.com stripchat.com camsoda.com eporner.com tnaflix.com hentaihaven.xxx
nhentai.net rule34.xxx porntrex.com hqporner.com adultfriendfinder.com fuckbook.net sluttywives.tv naughtymatures.biz teencams-live.com hotmilfs4u.com xxxvids.to bangbros.com
nudevista.com sexgalaxy.net camgirls24.ru pornhd8k.me tubegalore.com boobpedia.com erotic-massage-girls.eu swingers-club-hookups.com local-sluts.date milf-cams.tv xtapes.to
888casino.com betway.com unibet.eu pokerstars.bet 22bet.com melbet.org mostbet.in pinup-casino.ru vulkan-vegas.com slotomania-coins.net jackpotcity.com ladbrokes.bet bwin.net betfair.com
stake-crypto.bet roobet.com sbobet88.asia judi-slot-gacor.id togel4d.net dafabet.asia bet-master77.com livebetting-tips.co.ke spinsamurai.com bingobilly.com lotto-agent.win fortunejack.com
1337x.to rarbg.to kickasstorrents.cr limetorrents.lol yts-movies.mx fmovies.to 123movies.la putlocker.vip soap2day.to gomovies.sx primewire.li nulled.to crackedpc.org getintopc-crack.com
igg-games.co steamunlocked.to warez-bb.org keygenguru.com torrentz2.nz piratestreams.tv serialkey-download.net office-activator-kms.ru mp3skulls.to apk-modded.net cracksoft.info
doubleclick.net adnxs.com popads.net propellerads.com exoclick.com juicyads.com adclick.g.adservice.net trafficjunky.net clickadu.com adsterra.com zedo.com mgid-ads.com linkbucks.com shorte.st
adfoc.us ouo.io bc.vc adserver77.net popunder-traffic.com trk-clicks.xyz go2affise.com adzerk-cdn.net smartlink-offers.top push-notifications-allow.club clicktrackr.biz bannersnack-ads.ru
canadian-pharmacy24h.com rx-pills.biz tramadol-online.ru xanax-noprescription.com kamagra-shop.eu levitra20mg.net modafinil-store.in buy-ativan.top hgh-steroid-shop.com ozempic-cheap.shop
tadalafil-generic.su sildenafil100.com ed-pills-overnight.net oxycodone4sale.cc pharm-discount24.ru phentermine-rx.info
paypal.com.secure-login-update.ru appleid-verify-account.tk login-microsoft0nline.ml netflix-billing-update.cf amazon-security-alert.ga chase-verify-online.gq dhl-parcel-fee.top
wallet-connect-restore.xyz metamask-unlock.io.ws bankofamerica.auth-signin.cc irs-refund-claim.pw office365-password-reset.tk whatsapp-gold-update.club steamcommunnity.ru faceb00k-login.ml
icloud.com.find-device.support.cn account-suspended-verify.top signin.ebay.com.ws-confirm.ru secure.wellsfargo.verify-user.info coinbase-support-wallet.live usps-redelivery-fee.top paypa1-limited.cf
earn-btc-daily.biz double-your-eth.io forexrobot-profit.com binaryoptions-signal.net workfromhome-cash.club mlm-millionaire.info lottery-uk-winners.tk free-iphone15-giveaway.win claim-reward-now.top
survey-prizes.online robux-generator.fun vbucks-free.gg giftcard-codes.cc psychic-love-spells.net penis-enlarge.ru keto-gummies-trial.shop brainpill-review.biz hair-regrow-miracle.com
crypto-airdrop-claim.app passive-income-secrets.biz onlinecash4u.com payday-advance-now.net quickloan24.ru instant-followers.ru youtube-views-bot.com mega-jackpot-draw.win luckyspin-reward.xyz
rolexreplicas.cn louisvuitton-outlet.top fakebagsclub.ru cheap-jerseys-wholesale.cn yeezyreps.cc copywatch-swiss.to rayban-sale90.shop
essaypro-cheap.com do-my-homework.biz buyessay-online.net termpaper-writers.org dissertation4u.cc""".split()
#: Hosts of ordinary sites that have parts of unwanted ones' names, or are short, or have digits and hyphens.
ORDINARY = """freecodecamp.org freedesktop.org freepress.net freelancer.com freesound.org freshbooks.com free-speech-union.org freemasonry.london.museum gluten-free-recipes.co.uk
bestwestern.com besthealthmag.ca bestofneworleans.com asbestos-safety.gov.au buyingguide.which.co.uk buybacks.sec.gov buyersguide.photography.org onlinelibrary.wiley.com onlinecourses.mit.edu
winnipegfreepress.com windows.microsoft.com winecountry.com winterthur.ch winston-salem.gov superuser.com supermarketnews.com superiorcourt.ca.gov superfoods-nutrition.org
bigissue.com bigthink.com bigfishaquarium.org fastcompany.com fastmail.com breakfast-club.org hotjar.com hotels.com hotspring-parks.gov photos-archive.org luckymag.com luckylandranch.org
easyjet.com easybib.com getbootstrap.com getpocket.com gettyimages.com target-archery.org realpython.com realsimple.com realestate-law.edu instantpot.com instructables.com
secretlondon.com secretgarden-nursery.org cheapflights.com cheapeats-chicago.blog pharmacytimes.com pharmacopoeia.com pharmacy.ucsf.edu drugbank.ca medlineplus.gov clinicaltrials.gov pillar-geology.edu
pokemon.com pokeapi.co slotcar-racing.org.uk timeslot-scheduling.io studentloans.gov loanwords-linguistics.edu interlibrary-loan.org creditunion.coop credit.law.cornell.edu bitcoin.org coindesk.com
cryptography.io cryptomuseum.com cryptozoology-museum.com betterhealth.vic.gov.au betterhomes.com alphabet.xyz elizabethan-theatre.org diabetes.org.uk tibet-museum.org beta.ons.gov.uk
essex.ac.uk sussex.ac.uk middlesex.edu sexualhealth.nhs.uk sextant-navigation.org webcam.nationalpark.gov zoo-livecam.org carbon-dating-lab.edu archaeology-dating.org consolidating.eu
cartoonnetwork.com torrential-rain.metoffice.gov.uk torrent-river-kayak.fr crackerbarrel.com nutcracker-ballet.ru firecracker-press.com keyboards.ch keynes-society.org massagetherapy-board.gov
tubemap.london innertubes.co.uk youtube.com pirateship-museum.ca pittsburgh-pirates.mlb.com bittorrent-protocol.readthedocs.io trackandfieldnews.com railtrack.co.uk soundtrack.net
adriatic-cruises.hr adelaide.edu.au adventist.org addresses.data.gouv.fr madstone.cinema.org readers-digest.com roads.gov loads-engineering.edu clickhouse.com click.palletsprojects.com
nobelprize.org pulitzer-prizes.org heritage-lottery-fund.org.uk giftedchildren.org rewardsforjustice.net dietitian.org weightwatchers.com miraclegro.com steroidbiochem.journals.org endocrine-steroids.edu
replicaset.mongodb.com replica-island.github.io fakenews-research.eu rolexawards.org watchmakers-guild.ch hackathon.gov hackaday.com avast.com phishing-education.org login.gov verify.service.gov.uk
account.ui.com secure.ssa.gov signin.aws.amazon.com support.apple.com confirm.eventbrite.com update.kernel.org accounts.google.com wallet.google.com id.gov.ee sso.uni-heidelberg.de
milford-sound.nz milfoil-botany.org escort-club-ford.co.uk analytics.usa.gov assassin-bugs.entomology.edu cocktails.museum shitake-farm.jp peacock-sanctuary.in titmouse-birds.org grapefruit-growers.org
scunthorpe.gov.uk penistone.co.uk dickens-society.org hancock-county.gov matchmaker-chess.org adulteducation.edu adult-learning.gov.ie mature-students.ie teenlibrary.org teens.nypl.org
girlscouts.org girls-who-code.com boyscouts.org hot-air-balloons.nm.gov nude-in-art.metmuseum.org erotica-of-catullus.classics.edu essays.poetryfoundation.org homework-help.school.nz papers.nips.cc
winner-wine.at gamblers-anonymous.org gambling-research.ac.uk casino-royale-film.org montecarlo-methods.edu bingo-hall-history.uk roulette-curve.math.edu lotteries-history.bnf.fr
profit-sharing.coop nonprofit-quarterly.org forex.wikipedia.org cashmere-goats.mn cash-registers.museum earnings.bls.gov double-bass.org doubling-cube-backgammon.fr wages-and-salary.gov
4chords.fr 3blue1brown.com 9news.com.au 20minutes.fr 99percentinvisible.org 1001-nights.org k12.ca.us web3d.org x.org w3.org r-project.org 7-zip.org mp3dev.org h2o.ai b-tu.de""".split()
#: Ends of hosts, dealt alike to both classes, so that they don't tell them apart.
DOMAINS = "com net org de fr es info io co.uk edu biz ru nl it pl jp co.jp com.br in ca au us eu tv me online site club test example.com example.net example.org".split()
#: Paths that either class has, and those that one of them has more often.
PATHS = "|index.html|about|en/17|de/220.html|fr/8#top|es/3?page=2|contact|home|login|1203/|p/55?utm_source=feed".split("|")
LURE_PATHS = "free-spins/bonus|promo/claim-your-prize|buy-now/cheap|track.php?aff=123&sub=9|click?cid=88&redirect=1|xxx/gallery/12|casino/welcome-bonus|pills/order-online|download/crack-serial.exe|banner/ads.js|win/iphone|no-prescription/discount".split("|")
PLAIN_PATHS = "wiki/Main_Page|2023/05/first-post|docs/latest/sql-guide.html|products/list|user/project/blob/main/README.md|news/world/story-12|a/b/c.php?id=4|search?q=x|research/papers/2019.pdf|library/catalogue|opening-hours|questions/113/how-to".split("|")


def _table() -> Iterator[tuple[str, int]]:
    """(url, 1 to block), four for each name; joined names are written with and without a hyphen."""
    unwanted = [f"{LURES[(k + j) % len(LURES)]}{'-' if k % 2 else ''}{ware}" for k, ware in enumerate(WARES) for j in (0, 5, 11)] + WARES
    ordinary = [f"{PLACES[(k + j) % len(PLACES)]}{'-' if k % 2 else ''}{thing}" for k, thing in enumerate(THINGS) for j in (0, 7, 13)] + THINGS + KNOWN
    for y, names, own in ((1, unwanted, LURE_PATHS), (0, ordinary, PLAIN_PATHS)):
        for k, name in enumerate(names):
            for i, before in enumerate(("", "www.", "m.", "blog.")):
                path = (own if i % 2 else PATHS)[(3 * k + i) % len(own if i % 2 else PATHS)]
                yield f"https://{before}{name}.{DOMAINS[(5 * k + 7 * i) % len(DOMAINS)]}/{path}", y


def _written() -> Iterator[tuple[str, int]]:
    """(url, 1 to block), four for each written host."""
    for y, hosts, own in ((1, UNWANTED, LURE_PATHS), (0, ORDINARY, PLAIN_PATHS)):
        for k, host in enumerate(hosts):
            for i, before in enumerate(("", "", "www.", "")):  # as they are, with paths of either kind
                yield f"https://{before}{host}/{(own if i == 1 else PATHS)[(3 * k + i) % len(own if i == 1 else PATHS)]}", y


#: URLs of names made of words.
LABELLED = tuple(_table())
#: What the model is trained on: these, and the written hosts.
TABLE = (*LABELLED, *_written())


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path)."""
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, path = rest[:end], rest[end:]
    stop = min((i for i in map(path.find, "?#") if i >= 0), default=len(path))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path[:stop]


def grams(host: str, path: str, size: int = SIZE) -> np.ndarray:
    """Distinct hashed 3- to 5-grams of the host and 3-grams of the path's letters."""
    import xxhash

    marked = f"^{host}$"
    found = {f"h{marked[i : i + n]}" for n in (3, 4, 5) for i in range(len(marked) - n + 1)}
    found |= {f"p{path[i : i + 3]}" for i in range(len(path) - 2)}
    return np.array(sorted({xxhash.xxh64_intdigest(g) % size for g in found}), np.int64)


def train(labelled: Sequence[tuple[str, int]] = TABLE, size: int = SIZE, rounds: int = 600, rate: float = 8.0, decay: float = 2e-5) -> np.ndarray:
    """Weights and, last, the bias, by full-batch gradient descent with momentum: always the same for the same table."""
    rows = [grams(*split_url(u), size) for u, _ in labelled]
    y = np.array([b for _, b in labelled], float)
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    flat = np.concatenate(rows)
    scale = 1 / np.sqrt([max(1, len(r)) for r in rows])
    w, v = np.zeros(size + 1), np.zeros(size + 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(np.bincount(at, w[flat], len(rows)) * scale + w[size])))
        g = (p - y) / len(y)
        v *= 0.9
        v[:size] -= rate * (np.bincount(flat, (g * scale)[at], size) + decay * w[:size])
        v[size] -= rate * g.sum() / 8
        w += v
    return w


def probability(w: np.ndarray, host: str, path: str) -> float:
    """That the URL is to be blocked."""
    if not host:
        return 0.0
    x = grams(host, path, len(w) - 1)
    z = (w[x].sum() / np.sqrt(max(1, len(x))) if len(x) else 0.0) + w[-1]
    return float(1 / (1 + np.exp(-z)))


def longest_rule(rules: Sequence[tuple[str, str, str]], host: str, path: str) -> tuple[str, str] | None:
    """(rule, verdict) of the longest rule that fits."""
    fit = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[2:] if fit else None


def _judge(weights: np.ndarray, rules: Sequence[tuple[str, str, str]], block_from: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for url in batch.column(1).to_pylist():
                host, path = split_url(url)
                p = probability(weights, host, path)
                rule = longest_rule(rules, host, path)
                out.append((host, path, rule and rule[0], rule[1] if rule else "block" if p >= block_from else "allow", p))
            cols = [pa.array([r[i] for r in out], pa.float64() if i == 4 else pa.string()) for i in range(5)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["page_id", "host", "path", "rule", "verdict", "block_probability"])

    return run


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, labelled: Sequence[tuple[str, int]] = TABLE, block_from: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, block_probability of every row of pages."""
    d = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    return d.mapInArrow(tidy(_judge(train(labelled), tuple(rules), block_from), 4096), f"page_id {dict(d.dtypes)['page_id']}, host string, path string, rule string, verdict string, block_probability double")
