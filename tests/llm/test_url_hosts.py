"""The URL model on hosts of which none is in its table; they were written down before it was tried on them."""

from gaugeline.llm import urlfilter

UNWANTED = """beeg.com porn300.com sexvid.xxx nudecollect.com pornpics.com xtube.com slutload.com camwhores.tv jizzbunker.com hentaifox.com asianporntube.net wetpussygames.com betsson.com
bet9ja.com leovegas.com spinpalace.com royalpanda.com slotsheaven.com jackpotjoy.com 10bet.com casinoeuro.com sportsbet-vip.ru poker-freeroll.net torrentgalaxy.to
piratebay-proxy.org yify-torrents.com crackwatch.net keygens.nl free-warez.org watch-movies-hd.to mega-cracks.com adcash.com popcash.net hilltopads.com clickbank-offers.net
ads-tracker.club bannerclicks.xyz buy-xanax-online.com cheapviagra.org cialis-rx.net pillshop24.ru no-rx-meds.biz paypal-account-limited.tk secure-applepay-update.com
verify-mybank.cf netflix-payment-failed.top login-outlook-web.ml crypto-doubling.io btc-giveaway.net forex-millionaire.biz getfreerobux.club iphone-winner.win giftcards4free.top
fat-burner-secret.com replica-handbags.cn fakewatches.to essay-cheap4u.com payday-cash-now.net""".split()
ORDINARY = """freewheel-cycling.org bestiary.ca supernova-astronomy.edu winterfestival.se luckhurst-law.co.uk bigsurpark.org fastener-supplier.com hotsprings.gov easton-library.org
getirelandactive.ie realestate-institute.ca instantcoffee-history.com secretariat.un.org pharmaceutical-journal.com loanstar-museum.org creditreporting-law.gov
bitwise-operations.dev betony-herbs.co.uk essexhistory.org.uk geology-dating-methods.edu alpine-webcams.ch crackling-recipes.com keynote-speakers.org tubefeeding-support.org
pirates-of-penzance.co.uk trackcycling.org adastra.fi clickandgrow.com prizegiving.school.za giftshop.museum.org dietetics.org.nz miracleplays.ac.uk corticosteroids.nih.gov
replica-ships.nl watch-repair.edu montaigne-essays.fr login.university.ac.jp verified-voting.org accountancy-board.gov nytimes.com postgresql.org rust-lang.org zeit.de
folha.uol.com.br hm-treasury.gov.uk tokyo-u.ac.jp mayoclinic.org khanacademy.org openstreetmap.org letras.mus.br sbb.ch delta.com zillow.com webmd.com kicker.de lego.com
patagonia.com nps.gov chess.com duolingo.com""".split()


def test_hosts_outside_the_table():
    known = {urlfilter.split_url(u)[0].removeprefix("www.") for u, _ in urlfilter.TABLE}
    assert not known & {*UNWANTED, *ORDINARY}
    w = urlfilter.train()
    blocked, allowed = (sum((urlfilter.probability(w, h, "/") >= 0.5) == y for h in hosts) / len(hosts) for hosts, y in ((UNWANTED, True), (ORDINARY, False)))
    assert blocked >= 0.8 and allowed >= 0.8


def test_table_has_no_host_twice():
    hosts = [*urlfilter.UNWANTED, *urlfilter.ORDINARY]
    assert len(set(hosts)) == len(hosts) and {y for _, y in urlfilter.TABLE} == {0, 1}
