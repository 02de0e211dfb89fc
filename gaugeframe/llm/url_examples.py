"""A small labelled URL table to train the URL filter on: 1 is a page to block."""

# Addresses made up for this table under reserved names, from what spam and ordinary sites
# commonly call themselves. None is taken from a table that the filter judges.
BLOCKED = """
http://grand-casino-slots.example.com/free-spins
https://casino-royale-bonus.example.net/en/slots/jackpot
https://www.vegas-casino-online.example.org/roulette
http://jackpot-casino.example.org/signup-bonus
https://live-poker-bonus.example.net/tables
http://poker-jackpot-room.example.com/bonus/deposit
https://betting-bonus.example.com/odds/today
https://football-betting-tips.example.org/sure-win
http://m.bet-and-win-slots.example.net/en/bonus
https://viagra-without-prescription.example.com/order
http://generic-viagra-online.example.net/buy
https://www.buy-cialis-online.example.org/discount
http://cialis-generic.example.com/no-prescription
https://rx-pharmacy-discount.example.net/order/generic
http://canadian-pharmacy-online.example.com/buy/meds
https://diet-pills-miracle.example.org/order-now
http://slimming-pills-shop.example.net/lose-weight-fast
https://weight-loss-miracle.example.com/lose-20-pounds
http://miracle-weight-loss-tea.example.org/buy-now
https://payday-loans-instant.example.com/apply-now
http://instant-cash-loans.example.net/no-credit-check
https://quick-payday-cash.example.org/apply
http://bad-credit-loans-instant.example.com/en/apply-now
https://xxx-adult-videos.example.net/free
http://free-xxx-porn.example.com/watch/1203
https://porn-videos-hd.example.org/category/amateur
http://adult-webcam-girls.example.com/live
https://hot-girls-webcam.example.net/join-free
http://adult-dating-singles.example.org/join-free
https://meet-hot-singles.example.com/signup
http://escort-girls-adult.example.net/booking
https://replica-handbags-outlet.example.com/sale
http://replica-rolex-watches.example.org/discount
https://luxury-replica-outlet.example.net/handbags
http://designer-outlet-discount.example.com/sale/replica
https://full-version-crack.example.org/keygen/download
http://software-keygen-crack.example.com/serial
https://warez-full-download.example.net/crack
http://serial-keygen-archive.example.org/warez
https://free-movies-torrent-download.example.com/full-hd
http://torrent-warez-movies.example.net/download
https://double-your-bitcoin.example.org/invest
http://bitcoin-investment-profit.example.com/double
https://crypto-profit-robot.example.net/signup-bonus
http://forex-profit-robot.example.org/make-money
https://make-money-from-home-fast.example.com/join-free
http://earn-cash-from-home.example.net/easy-money
https://easy-money-online.example.org/earn
http://claim-your-free-prize.example.com/winner
https://free-gift-card-winner.example.net/claim
http://iphone-winner-prize.example.org/claim-now
https://www.lottery-winner-claim.example.com/prize
http://buy-backlinks-seo.example.net/packages
https://seo-backlinks-cheap.example.org/buy
http://buy-instagram-followers.example.com/cheap
https://cheap-followers-likes.example.net/buy
http://cheap-essay-service.example.org/buy-essay
https://buy-essay-papers-online.example.com/order
"""
ALLOWED = """
https://www.county-library.example.org/opening-hours
http://library.hillside-college.example.com/catalogue/search
https://archive.town-museum.example.net/collections/pottery
https://museum-of-glass.example.org/visit
http://www.national-gallery.example.com/exhibitions/2019
https://natural-history.example.net/fossils/ammonites
https://news.evening-post.example.com/2021/05/council-budget
http://www.daily-courier.example.org/politics/election-results
https://weekly-herald.example.net/sport/rowing-results
https://local-news.example.com/weather/forecast
http://weather-service.example.org/forecast/north
https://climate-data.example.net/stations/1042
https://docs.photo-editor.example.com/guide/install.html
http://docs.mailserver.example.org/manual/configuration
https://developer.map-tools.example.net/reference/api
https://wiki.gardeners.example.org/page/Tomato
http://wiki.railways.example.com/page/Branch_line
https://forum.woodworkers.example.net/topic/1882
https://forum.cyclists.example.org/threads/winter-tyres
http://questions.programmers.example.com/questions/40112/how-to-sort-a-list
https://physics.river-university.example.org/lectures/4
http://www.river-university.example.org/admissions
https://chemistry.lake-university.example.net/staff/publications
https://math.lake-university.example.net/seminars/algebra
https://journal-of-botany.example.com/articles/2018/17
http://papers.economics-institute.example.org/working/204
https://medical-school.example.net/departments/cardiology
https://health-advice.example.org/conditions/asthma
http://city-hospital.example.com/patients/appointments
https://www.city-council.example.org/services/recycling
http://parks.city-council.example.org/bookings
https://tax-office.example.net/forms/annual-return
https://parliament-records.example.org/debates/1998/march
http://law-reports.example.com/cases/appeal/77
https://legal-aid.example.net/advice/housing
https://village-school.example.org/term-dates
http://primary-school.example.com/news/spring-fair
https://music-conservatory.example.net/concerts/strings
https://orchestra.example.org/season/programme
http://folk-songs.example.com/lyrics/the-miller
https://poetry-archive.example.org/poets/a-z
https://classic-novels.example.net/chapters/12
http://bread-recipes.example.com/sourdough
https://family-kitchen.example.org/recipes/lentil-soup
https://blog.hill-walker.example.net/2016/10/autumn-ridge
http://blog.beekeeper.example.com/posts/swarming
https://bird-watching.example.org/species/heron
https://farm-diary.example.net/soil/compost
http://train-timetables.example.com/routes/coast
https://harbour-ferries.example.org/timetable/summer
https://travel-notes.example.net/italy/rome
https://walking-tours.example.com/en/old-town
http://astronomy-club.example.org/planets/saturn
https://space-agency.example.net/missions/orbiter
https://chess-club.example.com/openings/french
http://rowing-club.example.org/members
https://football-league.example.net/fixtures
https://language-school.example.com/fr/cours
http://tourist-office.example.org/de/museen
https://film-society.example.net/es/programa
https://genealogy-records.example.com/parish/1851
http://coin-collectors.example.org/catalogue/roman
https://hardware-store.example.net/products/hinges
https://bookshop.example.com/authors/history
http://bicycle-repairs.example.org/prices
https://bakery.example.net/about
http://www.plumber-directory.example.com/contact
https://charity-shop.example.org/donate
https://open-data.example.net/datasets/rainfall
http://statistics-office.example.com/tables/population
https://software-foundation.example.org/projects/compiler
http://mirror.software-foundation.example.org/releases/4.2
https://crossword-puzzles.example.net/archive
https://knitting-patterns.example.com/scarves
http://dictionary.example.org/words/lantern
https://encyclopedia.example.net/articles/volcano
http://translation-bureau.example.com/services
https://architects.example.org/portfolio/schools
http://photo-club.example.net/galleries/landscape
https://theatre.example.com/tickets/hamlet
http://cinema.example.org/showtimes
https://radio-station.example.net/schedule
http://podcast.example.com/episodes/31
https://veterinary-clinic.example.org/advice/cats
https://insurance-office.example.net/claims/form
http://post-office.example.com/tracking
https://bank-branch.example.org/accounts/savings
"""


def examples() -> list[tuple[str, int]]:
    """(url, label) for every address above."""
    return [(u, 1) for u in BLOCKED.split()] + [(u, 0) for u in ALLOWED.split()]
