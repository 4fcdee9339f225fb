"""Fixed values.

Word lists, patterns and limits that decide results.  They are rules of the
domain, kept in one place and in natural order so they can be reviewed.
"""

# --- fixed values: article-URL rules -------------------------------------
MIN_URL_LENGTH = 11
ALLOWED_FILE_TYPES = [
    "html", "htm", "md", "rst", "aspx", "jsp", "rhtml", "cgi", "xhtml", "jhtml", "asp",
]
GOOD_PATHS = [
    "story", "article", "feature", "featured", "slides", "slideshow", "gallery", "news",
    "video", "media", "v", "radio", "press",
]
BAD_CHUNKS = [
    "careers", "contact", "about", "faq", "terms", "privacy", "advert", "preferences",
    "feedback", "info", "browse", "howto", "account", "subscribe", "donate", "shop", "admin",
]
BAD_DOMAINS = ["amazon", "doubleclick", "twitter"]
URL_DATE_PATTERN = (
    r"([\./\-_]{0,1}(19|20)\d{2})[\./\-_]{0,1}"
    r"(([0-3]{0,1}[0-9][\./\-_])|(\w{3,5}[\./\-_]))([0-3]{0,1}[0-9][\./\-]{0,1})?"
)
MEDIA_URL_WORDS = [
    "/video", "/slide", "/gallery", "/powerpoint", "/fashion", "/glamour", "/cloth",
]
# Same language as the published free-text URL pattern, written as one
# character class so the matcher never recurses per character.
FREE_TEXT_URL_PATTERN = r"https?://[a-z$-_!]+"

# --- fixed values: category-URL rules ------------------------------------
MAX_CATEGORY_CHUNK = 14
CATEGORY_BAD_WORDS = [
    "about", "help", "privacy", "legal", "feedback", "sitemap", "profile", "account",
    "mobile", "sitemap", "facebook", "myspace", "twitter", "linkedin", "bebo", "friendster",
    "stumbleupon", "youtube", "vimeo", "store", "mail", "preferences", "maps", "password",
    "imgur", "flickr", "search", "subscription", "itunes", "siteindex", "events", "stop",
    "jobs", "careers", "newsletter", "subscribe", "academy", "shopping", "purchase",
    "site-map", "shop", "donate", "newsletter", "product", "advert", "info", "tickets",
    "coupons", "forum", "board", "archive", "browse", "howto", "how to", "faq", "terms",
    "charts", "services", "contact", "plus", "admin", "login", "signup", "register",
    "developer", "proxy",
]
MOBILE_SUBDOMAINS = ["m", "i"]
MAX_CRAWL_DEPTH = 2
CATEGORY_CACHE_SECONDS = 86400
POLL_SECONDS = 1800

# --- fixed values: boilerplate subtrees (id, class or name) --------------
BOILERPLATE_PATTERN = (
    "^side$|combx|retweet|mediaarticlerelated|menucontainer|"
    "navbar|storytopbar-bucket|utility-bar|inline-share-tools"
    "|comment|PopularQuestions|contact|foot|footer|Footer|footnote"
    "|cnn_strycaptiontxt|cnn_html_slideshow|cnn_strylftcntnt"
    "|^links$|meta$|shoutbox|sponsor"
    "|tags|socialnetworking|socialNetworking|cnnStryHghLght"
    "|cnn_stryspcvbx|^inset$|pagetools|post-attributes"
    "|welcome_form|contentTools2|the_answers"
    "|communitypromo|runaroundLeft|subscribe|vcard|articleheadings"
    "|date|^print$|popup|author-dropdown|tools|socialtools|byline"
    "|konafilter|KonaFilter|breadcrumbs|^fn$|wp-caption-text"
    "|legende|ajoutVideo|timestamp|js_replies"
)
# The second rule set differs in one word: a bare "links".
BOILERPLATE_PATTERN_BROAD = BOILERPLATE_PATTERN.replace("^links$", "links")
# Patterns tested on id and class only.
WIDGET_PATTERNS = [
    "^caption$", " google ", "^[^entry-]more.*$", "[^-]facebook", "facebook-broadcasting",
    "[^-]twitter",
]

# --- fixed values: known article containers, in order of trust -----------
# (tag, attribute, value); None means "any".
KNOWN_ARTICLE_CONTAINERS = [
    (None, "itemprop", "articleBody"),
    (None, "class", "post-content"),
    ("article", None, None),
    (None, "class", "article-text"),
    (None, "property", "articleBody"),
    (None, "class", "story"),
]

# --- fixed values: body scoring ------------------------------------------
MIN_STOP_WORDS = 2
BOOST_STOP_WORDS = 5
BOOST_STEPS = 3
BOOST_BASE = 50
TAIL_MIN_NODES = 15
TAIL_SHARE = 0.25
TAIL_LIMIT = 40
TAIL_FALLBACK = 5
SIBLING_SHARE = 0.30
SIBLING_DEFAULT_BASE = 100000
CHILD_SCORE_SHARE = 0.08
MIN_PARAGRAPH_CHARS = 25
FEW_WORDS = 3

# --- fixed values: publish date, (attribute, value, where) ---------------
PUBLISH_DATE_RULES = [
    ("property", "rnews:datePublished", "content"),
    ("property", "article:published_time", "content"),
    ("name", "OriginalPublicationDate", "content"),
    ("itemprop", "datePublished", "datetime"),
    ("class", "published-date", "text"),
    ("class", "date", "datetime"),
]
PUBLISH_DATE_META_RULES = [
    ("property", "rnews:datePublished", "content"),
    ("property", "article:published_time", "content"),
    ("name", "OriginalPublicationDate", "content"),
    ("itemprop", "datePublished", "datetime"),
    ("property", "og:published_time", "content"),
    ("name", "article_date_original", "content"),
    ("name", "publication_date", "content"),
    ("name", "sailthru.date", "content"),
    ("name", "PublishDate", "content"),
]

# --- fixed values: authors, titles, tags ----------------------------------
AUTHOR_RULES = [("itemprop", "name"), ("class", "byline_name")]
BYLINE_ATTRIBUTES = ["name", "rel", "itemprop", "class", "id"]
BYLINE_VALUES = ["author", "byline"]
TITLE_EDGE_SPLITTERS = ["|", "-", "»", ":"]
TAG_HREF_PARTS = ["/tag/", "/tags/", "/topic/", "?keyword="]
MAX_TITLE = 200
MAX_TEXT = 100000
MAX_KEYWORDS = 35
MAX_AUTHORS = 10
MAX_SUMMARY = 5000
MIN_WORD_COUNT = 300
MIN_SENTENCE_COUNT = 7
ARTICLE_HTML_TAGS = [
    "a", "span", "p", "br", "strong", "b", "em", "i", "tt", "code", "pre", "blockquote",
    "img", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd",
]

# --- fixed values: media --------------------------------------------------
BAD_IMAGE_NAMES = (
    ".html|.gif|.ico|button|twitter.jpg|facebook.jpg|ap_buy_photo"
    "|digg.jpg|digg.png|delicious.png|facebook.png|reddit.jpg"
    "|doubleclick|diggthis|diggThis|adserver|/ads/|ec.atdmt.com"
    "|mediaplex.com|adsatt|view.atdmt"
)
KNOWN_IMAGE_NAMES = [
    "yn-story-related-media", "cnn_strylccimg300cntr", "big_photo", "ap-smallphoto-a",
]
SITE_IMAGE_CLASSES = """\
latimes.com^thumbnail
cnn.com^storytext|cnn_strycntntlft
foxnews.com^entry-content
msn.com^articleText
go.com^mediaimage
lefigaro.fr^photo center
cadres.apec.fr^noFieldsTable
emploi.lesechos.fr^offerHeader
linkfinance.fr^offerHeader
"""
IMAGE_MIN_BYTES = 4000
IMAGE_MAX_BYTES = 15728640
IMAGE_MIN_WIDTH = 50
IMAGE_OUTER_MIN_WIDTH = 300
IMAGE_BASE_FACTOR = 1.48
IMAGE_MAX_PARENTS = 2
BANNER_RATIO = 5
MIN_IMAGE_AREA = 5000
THUMBNAIL_WIDTH = 90
MAX_IMAGE_RATIO = 16 / 9.0
VIDEO_PROVIDERS = ["youtube", "vimeo", "dailymotion", "kewego"]

# --- fixed values: topics --------------------------------------------------
TOKEN_PATTERN = (
    r"[A-Z](?:\.[A-Z])++\.?|[\p{L}\p{N}_]+(?:-[\p{L}\p{N}_]+)*+|\$?\d+(?:\.\d+)?%?"
    r"|\.\.\.|[\]\[.,;\"'?():-_`]"
)
PHRASE_PATTERN = r"\p{Lu}[\p{L}\p{N}_\-]*(?: \p{Lu}[\p{L}\p{N}_\-]*)*+"
MIN_TERM_WORD = 2
MAX_TERM_WORD = 40
MIN_TERM_CHARS = 3

# --- fixed values: graph maintenance ---------------------------------------
SOCIAL_DOMAINS = ["Twitter", "Facebook"]
UNLABELLED_DOMAIN = "Support"
UNKNOWN = "Unknown"

# --- fixed values: seed sites polled by the ingest loop --------------------
SEED_SITES = [
    "http://Cnn.com", "http://Nytimes.com", "http://Theguardian.com", "http://Bbc.co.uk/news/",
    "http://Washingtonpost.com", "http://Huffingtonpost.com", "http://Indiatimes.com",
    "http://News.yahoo.com", "http://Weather.com", "http://Forbes.com", "http://Foxnews.com",
    "http://Bloomberg.com", "http://Timesofindia.indiatimes.com", "http://Reuters.com",
    "http://Wsj.com", "http://Usatoday.com", "http://Money.cnn.com", "http://Wunderground.com",
    "http://Cnbc.com", "http://Drudgereport.com", "http://Chron.com", "http://Nbcnews.com",
    "http://Time.com", "http://Latimes.com", "http://Chinadaily.com.cn", "http://Usnews.com",
    "http://Economictimes.indiatimes.com", "http://Nypost.com", "http://Theatlantic.com",
    "http://Indianexpress.com", "http://Cbsnews.com", "http://News.com.au", "http://Thehill.com",
    "http://Hindustantimes.com", "http://Abcnews.go.com", "http://Sfgate.com",
    "http://Nationalgeographic.com", "http://Thehindu.com", "http://Cbc.ca/news/", "http://Dw.com",
    "http://Weather.gov", "http://Thedailybeast.com", "http://Hollywoodreporter.com",
    "http://Smh.com.au", "http://Economist.com", "http://Topix.com",
]

# --- fixed values: frequent function words of languages without a public list ---
# Chinese by character; Korean with the particles that end a word.
OWN_STOP_WORDS = {
    "ar": "في من على إلى عن مع أن إن كان كانت هذا هذه ذلك تلك التي الذي الذين ما لا لم لن قد هو هي هم كما أو ثم بل حتى "
          "بعد قبل بين كل بعض غير عند عندما منذ حيث إذا لكن ليس أي أما نحن أنا أنت له لها لهم به بها فيه فيها منه منها عليه عليها",
    "id": "yang dan di ke dari untuk pada dengan ini itu adalah tidak akan dalam oleh juga sudah telah bisa dapat ada "
          "saya kami kita anda dia mereka atau tetapi karena jika maka seperti lebih sangat hanya masih harus lagi "
          "agar bahwa sebagai saat ketika para serta antara bagi namun sebuah secara tersebut hingga belum",
    "ko": "은 는 이 가 을 를 에 의 도 로 와 과 만 에서 에게 으로 부터 까지 보다 처럼 하고 라고 그 저 것 수 등 및 또 더 "
          "그리고 그러나 하지만 또한 있다 있는 없다 없는 했다 한다 된다 된 한 할 하는 이다 있습니다 합니다 입니다 했습니다",
    "pl": "i w na z do nie się że to jest o jak po co tak za od ale czy już tylko przez dla był była było były jego jej "
          "ich lub oraz które który która są być przy pod nad bez ze może można tego tym ten ta te tej tych jednak gdy "
          "kiedy gdzie bardzo także również jeszcze mnie mi my wy oni on ona ono ja ty go mu by aby",
    "zh": "的 了 在 是 我 有 和 就 不 都 一 也 很 到 你 会 會 着 著 没 沒 这 這 那 他 她 它 们 們 与 與 及 或 而 但 对 對 把 被 从 從 "
          "以 之 为 為 其 因 所 于 於 等 个 個 并 並 又 还 還 将 將 要 让 讓 向 只 已 再 则 則 给 給 上 中 下",
}
