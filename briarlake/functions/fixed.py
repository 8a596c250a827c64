"""Word lists, patterns and constants that results depend on."""

import re

# Title patterns of price tables.
PRICE_TITLE_PATTERNS = [
    r"\brate today\b",
    r"\bprice today\b",
    r"\bprices today\b",
    r"\brates today\b",
    r"\brate on \d",
    r"\brates on \d",
    r"\btoday'?s? (gold|silver|price|rate)",
    r"\bcheck today",
    r"\bgold rate in\b",
    r"\bprice in \w+ today\b",
    r"\blive updates?\b",
    r"\bper tola\b",
    r"\b\d+ ?(karat|carat)\b",
    r"\bcity[- ]wise\b",
    r"\bbullion rates?\b",
]

# Outlets whose text is wanted.
QUALITY_DOMAINS = [
    "reuters.com", "bloomberg.com", "ft.com", "cnbc.com", "wsj.com", "marketwatch.com", "investing.com", "barrons.com", "economist.com",
    "apnews.com", "theguardian.com", "bbc.com", "bbc.co.uk", "nytimes.com", "washingtonpost.com", "forbes.com", "businessinsider.com", "axios.com",
    "cnn.com", "nbcnews.com", "abcnews.go.com", "cbsnews.com", "npr.org", "telegraph.co.uk", "thetimes.co.uk", "independent.co.uk", "standard.co.uk",
    "aljazeera.com", "dw.com", "france24.com", "scmp.com", "japantimes.co.jp", "kitco.com", "mining.com", "oilprice.com", "rigzone.com",
    "spglobal.com", "coindesk.com", "cointelegraph.com", "theblock.co", "decrypt.co", "fxstreet.com", "dailyfx.com", "forexlive.com",
    "seekingalpha.com", "miningweekly.com", "tradingview.com", "investopedia.com", "nypost.com", "thestreet.com", "benzinga.com", "zerohedge.com",
    "moneycontrol.com", "livemint.com", "economictimes.indiatimes.com", "business-standard.com", "cnbctv18.com", "financialexpress.com",
    "gulfnews.com", "arabnews.com", "english.alarabiya.net", "channelnewsasia.com", "straitstimes.com", "theedgemalaysia.com",
    "visualcapitalist.com", "statista.com", "worldgoldcouncil.org", "lbma.org.uk", "bullionvault.com", "goldhub.com", "morningstar.com", "yahoo.com",
    "fortune.com", "time.com", "newsweek.com",
]

# On-story queries by asset, their longer form, and off-story queries.
STORY_QUERIES = {
    "gold": ["gold price", "gold safe haven demand", "gold Federal Reserve", "gold dollar yields", "gold investors central banks", "precious metals market"],
    "crypto": ["bitcoin price", "bitcoin selloff investors", "crypto regulation SEC", "bitcoin institutional ETF", "crypto exchange market", "cryptocurrency market news"],
    "petrol": ["oil prices", "crude oil OPEC production", "oil supply disruption", "oil inventories demand", "brent crude market", "oil geopolitical supply"],
    "forex": ["pound sterling dollar", "sterling Bank of England", "pound UK economy", "sterling gilt yields", "pound government fiscal", "currency markets sterling"],
}
LONG_QUERIES = {
    "gold": ["gold prices rally investors safe haven Federal Reserve"],
    "crypto": ["bitcoin falls investors selloff market"],
    "petrol": ["oil prices crude supply OPEC market"],
    "forex": ["sterling pound falls dollar markets Bank of England"],
}
OFF_STORY_QUERIES = {
    "gold": ["gold mining company", "gold jewellery demand", "central bank gold reserves"],
    "crypto": ["blockchain technology adoption", "crypto regulation proposal", "NFT market"],
    "petrol": ["refinery maintenance", "electric vehicle sales", "renewable energy investment"],
    "forex": ["UK retail sales", "tourism spending", "trade balance figures"],
}

# Markers of opinion.
OPINION_MARKERS = [
    "analysts said", "analysts expect", "could see", "may rise", "is expected to", "predicts", "forecasts that", "warned that", "believes", "according to analysts",
]

# Phrases that restate a price move.
PRICE_PHRASES = [
    "moving average", "support level", "resistance", "chart", "trading volume", "was priced at", "traded at", "price rose", "price fell", "price spiked",
    "price surged", "price climbed", "price dropped", "gain of", "loss of", "percent in the last", "highest since", "lowest since", "market cap",
    "order book", "btc/usd", "trading session", "leveled out", "rallied to", "24 hours", "intraday", "spiked", "surged", "soared", "plunged", "tumbled",
    "slumped", "the surge", "the rally", "the selloff", "the plunge", "sudden rise", "sudden fall", "sharp rise", "sharp drop", "big revival",
    "enjoying the", "experienced a", "climbed to", "plummeted", "skyrocketed", "cratered", "nosedived", "wiped out", "erased", "pared",
    "over the past year", "over the last year", "in recent months", "has been rising", "has been falling", "steadily", "gradually", "now make up",
    "now makes up", "rose steeply", "trend of", "jumped to", "fell to", "rose to", "hit a high", "hit a low", "record high", "record low", "week high",
    "week low", "month high", "month low", "all-time high", "all-time low",
]
ASSET_WORDS = ["bitcoin", "btc", "gold", "brent", "wti", "crude", "sterling", "the pound", "ether", "crypto"]
HARD_PRICE_PHRASES = ["moving average", "trading volume", "order book", "was priced at", "over the past year", "now make up"]

# Words that carry no content, for entity resolution and for distractor classes.
STOPWORDS = [
    "the", "a", "an", "of", "to", "in", "on", "and", "for", "by", "at", "as", "its", "it", "was", "were", "is", "are", "that", "this", "with",
    "from", "after", "before", "has", "had", "have", "been", "be", "which", "their", "said", "announced", "would", "will", "over", "into", "about",
    "more", "than", "all", "up", "down",
]
SHORT_STOPWORDS = [
    "the", "a", "an", "of", "to", "in", "on", "and", "for", "by", "at", "as", "its", "it", "was", "were", "is", "are", "that", "this", "with",
    "from", "after", "before", "has", "had", "have", "been", "be", "which", "their",
]

# Capitalised words that name nobody.
GENERIC_NAMES = [
    "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "january", "february", "march", "april", "may", "june", "july",
    "august", "september", "october", "november", "december", "crypto", "cryptocurrency", "bitcoin", "the", "this", "that", "most", "after",
    "before", "during", "us", "u.s", "american", "chief", "executive", "president", "company", "firm", "lender", "exchange", "group", "report",
    "reports",
]

# Verb families by their stems.
ACTION_STEMS = [
    ["halt", "paus", "suspend", "freez", "stopp", "block", "withdraw"],
    ["acquir", "merg", "buyout", "takeover", "deal", "purchas"],
    ["fil", "appli", "submit", "list", "regist", "approv", "appear"],
    ["cut", "slash", "reduc", "lower", "decreas", "trim"],
    ["rais", "hike", "increas", "lift", "boost"],
    ["sanction", "ban", "restrict", "prohibit", "embargo"],
    ["sue", "lawsuit", "charg", "investigat", "probe", "accus", "alleg"],
    ["resign", "quit", "step down", "fired", "depart", "exit"],
    ["collaps", "bankrupt", "insolven", "fail", "default", "seiz", "clos"],
    ["attack", "strike", "invad", "bomb"],
]

# The text of the option that rejects all others, as written and as looked for.
NONE_OPTION = "None of the other options are correct causes."
NONE_MARKER = "None of the others are correct causes"

MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]

# Fixed value: the beginning of every none option, as the gate looks for it.
NONE_GATE_MARKER = "None of the other"

# Shapes of model replies.
REPLY_FENCE = re.compile(r"^```(?:json)?|```$", re.M)
REPLY_SCORE = re.compile(r'"?score"?\s*[:=]\s*([0-3])')
REPLY_ANSWER_OBJECT = re.compile(r'\{[^{}]*"answer"\s*:\s*(\[[^\]]*\]|"[A-D]")[^{}]*\}', re.S)
REPLY_ANSWER_LIST = re.compile(r'"answer"\s*:\s*\[(.*?)\]', re.S)
REPLY_ANSWER_PROSE = re.compile(r"(?:answer|correct|select)[^.\n]*?((?:\b[A-D]\b[,\s and&]*)+)", re.I)
REPLY_LINE = re.compile(r"^[\s\-\*]*([A-D])[.):\s]", re.M)
REPLY_LETTER = re.compile(r"\b([A-D])\b")

# Why a candidate needs review, and why it is scored without a model.
REVIEW_UNSCORED = "no model scored this"
REVIEW_SINGLE = "only one model scored this, no cross-check"
REVIEW_SPREAD = "models disagree by %d"
REVIEW_BOUNDARY = "sits on the include/exclude boundary"
REVIEW_MISSING = "no score returned"
AUTO_ZERO = "dated after the target event"

# What an unavailable model's error says.
DEAD_MODEL = ["model_not_found", "does not exist", "404"]

# The source dataset's published figures, by metric.
PUBLISHED = {"multi_answer_pct": 43.58, "mean_gold": 1.574, "docs_per_topic": 19.67}
