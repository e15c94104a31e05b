"""Dictionaries as data: label -> keywords. Callers may pass their own; these are the defaults."""

from __future__ import annotations

# ---- Fixed values: word lists whose members results depend on. Publishers' own brands are a parameter, not here. ----

#: Canonical company name -> spellings (lower case).
COMPANIES = {
    "Flutter": ["flutter entertainment", "flutter plc", "flutter entertainment plc"],
    "DraftKings": ["draftkings inc", "draftkings inc.", "draft kings"],
    "FanDuel": ["fanduel group", "fan duel"],
    "Entain": ["entain plc", "gvc holdings"],
    "Evolution": ["evolution gaming", "evolution gaming group"],
    "BetMGM": ["betmgm llc", "bet mgm"],
    "Caesars": ["caesars entertainment", "caesars entertainment inc"],
    "Penn Entertainment": ["penn entertainment", "penn national gaming", "penn interactive"],
    "Boyd Gaming": ["boyd gaming corporation"],
    "MGM": ["mgm resorts", "mgm resorts international"],
    "Kambi": ["kambi group", "kambi group plc"],
    "Playtech": ["playtech plc"],
    "IGT": ["international game technology", "igt plc"],
    "Aristocrat": ["aristocrat leisure", "aristocrat leisure limited"],
    "Light & Wonder": ["light & wonder", "light and wonder", "scientific games"],
    "Sportradar": ["sportradar group", "sportradar ag"],
    "Genius Sports": ["genius sports group", "genius sports limited"],
    "GeoComply": ["geocomply solutions"],
    "Fanatics": ["fanatics betting", "fanatics gaming"],
    "Betsson": ["betsson group", "betsson ab"],
    "Kindred": ["kindred group", "kindred group plc"],
    "888": ["888 holdings", "888 holdings plc"],
    "Wynn": ["wynn resorts", "wynn interactive"],
    "Las Vegas Sands": ["las vegas sands corp", "lvs"],
    "Tabcorp": ["tabcorp holdings"],
    "BetMakers": ["betmakers technology", "betmakers technology group"],
    "OpenBet": ["openbet (igt)"],
    "SBTech": ["sbtech (draftkings)"],
    "Evoke": ["evoke plc", "888 (evoke)"],
    "Inspired": ["inspired entertainment"],
    "Novomatic": ["novomatic ag"],
    "Konami": ["konami gaming", "konami holdings"],
    "PMU": ["pmu", "pari mutuel urbain", "pari mutuel urbain (pmu)", "pari mutuel urbain (pmu"],
}

#: Region -> place names.
REGIONS = {
    "North America": [
        "united states", "usa", "us", "america", "canada", "alabama", "alaska", "arizona", "arkansas", "california", "colorado", "connecticut", "delaware", "florida", "georgia", "hawaii", "idaho", "illinois", "indiana", "iowa", "kansas", "kentucky", "louisiana", "maine", "maryland", "massachusetts", "michigan", "minnesota", "mississippi", "missouri", "montana", "nebraska", "nevada", "new hampshire", "new jersey", "new mexico", "new york", "north carolina", "north dakota", "ohio", "oklahoma", "oregon", "pennsylvania", "rhode island", "south carolina", "south dakota", "tennessee", "texas", "utah", "vermont", "virginia", "washington", "washington state", "west virginia", "wisconsin", "wyoming", "washington d.c.", "washington dc", "dc", "las vegas", "vegas", "atlantic city", "reno", "ontario",
    ],
    "Europe": ["united kingdom", "uk", "britain", "great britain", "england", "scotland", "wales", "ireland", "germany", "france", "spain", "italy", "netherlands", "sweden", "denmark", "norway", "finland", "switzerland", "austria", "belgium", "portugal", "greece", "czech republic", "poland", "malta", "gibraltar", "cyprus"],
    "LatAm": [
        "brazil", "brasil", "argentina", "colombia", "peru", "chile", "uruguay", "paraguay", "venezuela", "ecuador", "bolivia", "panama", "costa rica", "mexico", "guatemala", "honduras", "el salvador", "nicaragua", "belize", "cuba", "dominican republic", "haiti", "jamaica", "trinidad and tobago", "trinidad", "tobago", "barbados", "bahamas", "aruba", "curacao", "curaçao", "bonaire", "sint maarten", "saint martin", "anguilla", "antigua", "barbuda", "antigua and barbuda", "dominica", "grenada", "saint lucia", "saint vincent", "grenadines", "saint kitts", "nevis", "montserrat", "cayman islands", "turks and caicos", "british virgin islands", "us virgin islands", "puerto rico", "guyana", "suriname", "french guiana", "guadeloupe", "martinique", "saba", "sint eustatius", "buenos aires", "sao paulo", "são paulo", "rio de janeiro", "caribbean", "latin america", "latin-america", "latam",
    ],
    "Asia Pacific": ["australia", "new zealand", "japan", "south korea", "singapore", "hong kong", "macau", "philippines", "thailand", "vietnam", "india", "china", "taiwan", "malaysia", "indonesia"],
    "Middle East & Africa": ["united arab emirates", "uae", "dubai", "south africa", "kenya", "nigeria", "egypt", "morocco", "israel", "saudi arabia", "mena", "gcc", "middle east", "mea", "africa"],
}

#: Topic cluster -> keywords.
TOPICS = {
    "Regulation & Compliance": ["regulation", "regulatory", "compliance", "license", "licensing", "legal", "law", "legislation", "tax", "taxation", "ban", "banned", "prohibition", "fine", "penalty", "sanction", "regulator", "gambling commission"],
    "M&A & Partnerships": ["merger", "acquisition", "deal", "partnership", "joint venture", "investment", "funding", "takeover", "buyout"],
    "Technology & Innovation": ["technology", "innovation", "ai", "artificial intelligence", "blockchain", "cryptocurrency", "crypto", "bitcoin", "nft", "web3", "platform", "mobile", "app", "digital"],
    "Sports Betting": ["sports betting", "sportsbook", "sports book", "sports wagering", "betting odds", "odds", "in-play", "live betting", "parlay", "point spread", "moneyline", "over/under", "over under", "sports handle", "betting handle", "betting revenue", "nfl betting", "nba betting", "mlb betting", "nhl betting", "horse racing", "race betting", "prop bet", "prop bets", "futures bet"],
    "Responsible Gaming": ["responsible gaming", "responsible gambling", "problem gambling", "addiction", "self-exclusion", "safer gambling"],
    "Esports & Emerging": ["esports", "e-sports", "daily fantasy", "dfs", "prediction market", "prediction markets", "social casino"],
    "Market Expansion": ["expansion", "launch", "enter", "debut", "growth"],
}

#: Formats of the corpus comparison, in order of preference on ties.
FORMATS = {
    "interview": ["interview", "spoke to", "talked to", "q&a", "conversation with"],
    "guide": ["guide", "how to", "tutorial", "step by step", "beginner"],
    "analysis": ["analysis", "deep dive", "breakdown", "explained", "in-depth"],
    "opinion": ["opinion", "commentary", "editorial", "perspective", "viewpoint"],
    "news": ["announces", "launches", "releases", "unveils", "reports"],
    "report": ["report", "study", "research", "survey", "findings"],
    "preview": ["preview", "upcoming", "what to expect", "look ahead"],
    "review": ["review", "recap", "roundup", "summary", "highlights"],
}
#: Formats of the topic indices.
TOPIC_FORMATS = {
    "explainer": ["explainer", "explained", "what is", "understanding", "breakdown"],
    "guide": ["guide", "how to", "tutorial", "step by step", "beginner", "complete guide"],
    "interview": ["interview", "spoke to", "talked to", "q&a", "conversation with", "exclusive with"],
    "analysis": ["analysis", "deep dive", "in-depth", "examining", "insights"],
    "opinion": ["opinion", "commentary", "editorial", "perspective", "viewpoint", "why i think"],
    "data story": ["data", "statistics", "numbers", "report", "study", "research", "survey"],
    "news": ["announces", "launches", "releases", "unveils", "reports", "confirms"],
    "preview": ["preview", "upcoming", "what to expect", "look ahead"],
    "review": ["review", "recap", "roundup", "summary", "highlights"],
}
VALUED_FORMATS = ["explainer", "guide", "interview", "analysis", "opinion", "data story", "deep dive", "tutorial", "how to", "report"]
MARKETS = {
    "latam": ["brazil", "mexico", "argentina", "colombia", "peru", "chile", "latin america", "latam"],
    "africa": ["africa", "nigeria", "kenya", "south africa", "ghana", "african"],
    "asia": ["asia", "japan", "philippines", "macau", "singapore", "asian", "apac"],
    "europe": ["europe", "uk", "germany", "spain", "italy", "france", "european", "emea"],
    "north_america": ["usa", "us ", "united states", "canada", "american", "north america"],
    "emerging": ["emerging markets", "frontier markets", "developing"],
}
STOPWORDS = "the and for that with this from will are was have has been their more new its also but not than into can which about other out one all who said they were what when there your how had would could just some over such only after most any through gaming igaming betting gambling casino online industry market company companies business operator operators player players game games sports sportsbook esports".split()
COMMON_WORDS = "the a an and or but in on at to for of with by from as is was are were been be have has had do does did will would could should may might must shall can need this that these those it its they their he she we you i my your our his her".split()
NOT_TOPICS = "com www http https html magazine news article read more click here".split()
IGNORED_ENTITIES = ["Gaming", "Casino", "Casinos", "iGaming", "Betting", "Sports", "Online", "Digital", "Market", "Markets", "Industry", "Business", "Company", "Companies", "Operator", "Operators", "Platform", "Platforms", "Report", "Reports", "News", "Article", "Articles", "Story", "Stories", "Year", "Month", "Week", "Day", "Time", "Today", "Yesterday", "How", "What", "Why", "When", "Where", "New", "Latest", "First", "Last", "Next", "Top", "Best", "Big", "Major", "Key", "Main", "Group", "Holdings", "International", "Global", "World", "Entertainment", "Interactive", "Solutions", "Services", "Technologies", "Board", "Board Member", "Council", "Committee"]
ROLES = ["CEO", "CFO", "COO", "CTO", "CMO", "CIO", "CRO", "CPO", "CHRO", "CSO", "CDO", "Chairman", "Chairwoman", "Chairperson", "Chair", "President", "Vice President", "VP", "EVP", "SVP", "AVP", "Director", "Managing Director", "Executive Director", "General Manager", "Manager", "Commissioner", "Minister", "Secretary", "Ambassador", "Head", "Chief", "Officer", "Founder", "Co-Founder", "Owner", "Partner"]
PLATFORM_DOMAINS = ["google.com", "youtube.com", "x.com", "twitter.com", "linkedin.com", "instagram.com", "facebook.com", "meta.com", "apple.com", "amazon.com", "microsoft.com", "tiktok.com", "whatsapp.com"]
EXPLAINER_SIGNALS = ["explainer", "what it means", "analysis", "deep dive", "guide", "breakdown", "explained", "how to", "understanding", "insight", "in-depth", "comprehensive", "detailed", "examination", "why", "implications", "impact", "future of", "state of"]
FRANCHISE_PATTERNS = ["most influential", r"top \d+", r"power \d+", "rising stars?", "women in", "men in", "awards?", "ranking", "list", "winners?", "annual", "quarterly", "monthly", "weekly roundup", "week in review"]
EVENT_SIGNALS = ["barcelona", "summit", "conference", "show floor", "panel", "keynote", "networking", "expo", "london", "amsterdam", "las vegas", "g2e", "affiliate", "event", "speaker", "session", "booth", "exhibition"]
GEOGRAPHIES = ["india", "brazil", "latam", "latin america", "nigeria", "africa", "philippines", "asia", "japan", "south korea", "mexico", "colombia", "argentina", "peru", "chile", "uk", "united kingdom", "britain", "us", "usa", "united states", "germany", "spain", "italy", "france", "netherlands", "sweden", "denmark", "malta", "gibraltar", "canada", "australia", "europe", "european", "north america", "apac", "mena", "emea"]
#: Classes of gaps, in order of precedence: a class is taken if any of its patterns occurs.
GAP_CLASSES = {
    "executive": ["executive", "ceo", "cfo", "cto", "coo", "chief", "director", "appointment", "appointed", "hire", "hiring", "leadership", "promotion", "promoted", "joins", "joined", "names", "named", "head of", "vp ", "vice president", "president", "officer", "talent", "personnel", "management", "board", "chairman"],
    "partnership": ["partner", "partnership", "acquisition", "acquire", "acquired", "merger", "deal", "agreement", "collaboration", "alliance", "joint venture", "investment", "investor", "stake", "m&a"],
    "regulation": ["regulat", "compliance", "license", "licensing", "legal", "legislation", "law", "government", "authority", "commission", "approval", "approved", "permit", "certification", "certified", "responsible gambling", "safer gambling", "player protection"],
    "market": ["market", "expansion", "expand", "geography", "region", "country", "enter", "entering", "entry", "latam", "brazil", "africa", "asia", "europe", "americas", "growth", "opportunity"],
    "product": ["launch", "launches", "launched", "unveil", "unveiled", "introduce", "introduces", "introduced", "release", "released", "new product", "new feature", "platform", "solution", "technology", "innovation", "upgrade", "rollout", "debut", "announce", "announcement"],
}
#: What an article must mention to be evidence for a class; every list of a class must be met.
EVIDENCE = {
    "executive": [
        ["ceo", "cfo", "cto", "coo", "chief", "director", "vp", "vice president", "president", "officer", "head of", "managing director", "chairman", "board member"],
        ["appoint", "appointed", "hire", "hired", "hiring", "promote", "promoted", "join", "joins", "joined", "name", "names", "named", "welcome", "welcomes"],
    ],
    "product": [["launch", "launches", "launched", "unveil", "unveiled", "introduce", "introduces", "introduced", "release", "released", "debut", "debuts", "debuted", "rollout", "roll out", "rolls out", "new platform", "new product", "new solution", "new feature", "announces", "announced", "live with", "goes live"]],
    "regulation": [["regulat", "compliance", "license", "licensing", "licensed", "legal", "legislation", "law", "government", "authority", "commission", "approval", "approved", "permit", "certified", "certification", "responsible gambling", "safer gambling", "player protection", "aml", "kyc"]],
    "market": [["expansion", "expand", "expands", "expanded", "enter", "enters", "entered", "entry", "market", "region", "latam", "brazil", "africa", "asia", "europe", "americas", "north america", "debut in", "launches in", "live in", "available in"]],
    "partnership": [["partner", "partnership", "partners with", "acquisition", "acquire", "acquires", "acquired", "merger", "merges", "deal", "agreement", "collaboration", "alliance", "joint venture", "investment", "stake", "signs with"]],
}
#: Phrases that name a region where no place of its list was found.
REGION_PHRASES = {
    "North America": ["las vegas", "nevada", "new jersey", "atlantic city", "california", "new york", "pennsylvania", "michigan", "ohio", "illinois", "arizona", "colorado", "massachusetts", "connecticut", "indiana", "iowa", "louisiana", "maryland", "virginia", "west virginia", "tennessee", "kansas", "missouri", "florida", "texas", "washington state", "tribal gaming", "tribal casino", "tribal law", "indian gaming", "native american", "united states", "u.s.", " usa ", "american gaming", "foxwoods", "mohegan sun", "seneca gaming", "san manuel", "pechanga", "station casinos", "venetian", "wynn resorts", "mgm", "caesars", "hard rock", "draftkings", "fanduel", "betmgm"],
    "LatAm": ["latam", "latin america", "latin-america", "brazil", "brasil", "argentina", "mexico", "colombia", "chile", "peru", "uruguay"],
    "Middle East & Africa": ["mena", "gcc", "middle east", "mea", "africa", "uae", "dubai", "saudi", "south africa", "nigeria", "kenya", "egypt"],
    "Europe": ["uk ", " uk", "united kingdom", "britain", "british", "germany", "spain", "italy", "france", "netherlands", "sweden", "denmark", "malta", "gibraltar", "isle of man", "alderney", "european", " eu "],
    "Asia Pacific": ["asia", "asian", "japan", "philippines", "macau", "singapore", "australia", "new zealand", "india", "south korea", "thailand", "vietnam"],
}
#: Pairs of words that are phrases though one of them is common.
PHRASES = ["sports betting", "responsible gambling", "online gaming", "prediction markets", "match fixing", "salary trends", "uk tax", "us market", "latin america", "north america", "mobile gaming", "live casino", "slot games", "table games", "affiliate marketing", "player protection", "age verification", "money laundering", "gambling commission", "gaming license"]
#: Segment of a company -> what its contexts mention, in order of preference on ties.
SEGMENTS = {
    "sports": ["sports", "sportsbook", "betting", "football", "soccer", "odds"],
    "casino": ["casino", "slot", "slots", "roulette", "blackjack", "table games"],
    "poker": ["poker", "tournament", "wsop"],
    "lottery": ["lottery", "lotto", "draw"],
    "esports": ["esports", "esport", "gaming", "competitive"],
    "payments": ["payment", "transaction", "wallet", "crypto", "blockchain"],
    "regulation": ["regulation", "compliance", "license", "authority", "legal"],
}
TRACKING_PREFIXES = ["utm_", "fbclid", "gclid", "mc_cid", "mc_eid", "ref", "source", "campaign"]
TRACKING_NAMES = ["fbclid", "gclid", "mc_cid", "mc_eid", "ref", "source", "campaign"]
# ---- End of fixed values. ----


def rows(lexicon: dict[str, list[str]]) -> list[tuple[str, str]]:
    """(keyword, label) pairs."""
    return [(k, label) for label, ks in lexicon.items() for k in ks]
