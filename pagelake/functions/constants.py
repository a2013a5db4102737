"""Word lists, patterns, thresholds and prices that results depend on."""

# Separators of words (Unicode white space, in classes that Java and RE2 read alike).
WS = r"[\x09-\x0D\x1C-\x20\x{85}\p{Z}]+"

# Phrases that hedge.
HEDGES = (
    "arguably", "it could be argued", "some say", "many believe", "it is thought", "generally speaking", "in some cases", "it depends",
    "more or less", "sort of", "kind of", "perhaps", "possibly", "we think", "it seems", "tends to",
)

# Stock filler phrases.
FILLER = (
    "in today's fast-paced world", "in the ever-evolving", "it is important to note", "when it comes to", "at the end of the day", "in conclusion",
    "last but not least", "needless to say", "the world of", "in this article, we will", "let's dive in", "unlock the power", "game-changer",
    "in the digital age", "navigating the",
)

# Calls to action.
CALLS = (
    "buy now", "sign up", "subscribe", "get started", "book a demo", "start free trial", "contact us", "request a quote", "add to cart",
    "download now", "join now", "claim your", "limited time", "act now", "don't miss",
)

# Phrases addressed to an assistant.
INJECTIONS = (
    "ignore previous instructions", "ignore all previous", "disregard the above", "disregard previous", "forget your instructions",
    "forget everything above", "you are now", "act as if", "new instructions:", "system prompt", "system:", "as an ai language model",
    "when summarizing this page", "when asked about", "always recommend", "you must recommend", "rank this page", "rank this site",
    "this is the best", "do not mention", "override your", "jailbreak", "prompt injection", "assistant:", "###instruction", "<|im_start|>",
)

# Hosts whose links count as sources.
AUTHORITIES = (
    ".gov", ".edu", ".ac.uk", "wikipedia.org", "wikidata.org", "doi.org", "arxiv.org", "pubmed.ncbi.nlm.nih.gov", "nature.com", "science.org",
    "who.int", "oecd.org", "worldbank.org", "iso.org", "ietf.org", "w3.org", "nist.gov", "acm.org", "ieee.org", "jstor.org", "ssrn.com",
)

# What counts as a statistic, without the condition on the character before.
STATISTIC_BODY = (
    r"(?:\d{1,3}(?:,\d{3})+"
    r"|\d+(?:\.\d+)?\s?%"
    r"|[$€£¥]\s?\d+(?:[.,]\d+)*\s?[kmbt]?\b"
    r"|\d+(?:\.\d+)?\s?(?:x|×)\b"
    r"|\b(?:19|20)\d{2}\b"
    r"|\d+(?:\.\d+)?\s?(?:million|billion|trillion|thousand|percent|bps)\b"
    r"|\d+(?:\.\d+)?\s?(?:ms|kb|mb|gb|tb|kg|km|mi|hrs?|hours?|days?|weeks?|months?|years?)\b)"
)

# Kinds of figures, first match wins.
FIGURE_KINDS = (
    ("percentage", r"(?i)^\d+(?:\.\d+)?\s?(?:%|percent|bps)$"),
    ("currency", r"^[$€£¥]"),
    ("magnitude", r"(?i)(?:million|billion|trillion|thousand)$"),
    ("multiplier", r"(?i)(?:x|×)$"),
    ("year", r"^(?:19|20)\d{2}$"),
    ("measurement", r"(?i)(?:ms|kb|mb|gb|tb|kg|km|mi|hrs?|hours?|days?|weeks?|months?|years?)$"),
    ("large number", r"^\d{1,3}(?:,\d{3})+$"),
)
NOT_CHARTABLE = ("year", "other")

# Characters without a width, and how many are too many.
INVISIBLE = ("​", "⁠", "﻿", "­", "᠎", "⁡", "⁢", "⁣", "⁤")

# Intents in the order in which they are tried.
INTENTS = (
    ("transactional", r"(?i)\b(buy|price|pricing|cost|cheap|discount|coupon|deal|order|subscription|trial|quote|hire|book)\b"),
    ("commercial", r"(?i)\b(best|top|review|reviews|compare|comparison|vs|versus|alternative|alternatives)\b"),
    ("navigational", r"(?i)\b(login|log in|sign in|download|app|dashboard|portal|documentation|docs|support)\b"),
    ("informational", r"(?i)\b(how|what|why|when|where|which|who|guide|tutorial|examples?|meaning|definition|is|are|does|can)\b"),
)

# Words left out of keyword tokens.
KEYWORD_STOP = ("the", "a", "an", "for", "of", "to", "in", "on", "and", "or", "is", "are", "with", "best", "top", "how", "what", "why", "vs", "my", "your")

# Words in front of or behind a seed.
QUESTION_WORDS = ("how", "what", "why", "when", "where", "which", "who", "can", "is", "are", "does", "do", "should", "will")
PREPOSITIONS = ("for", "with", "without", "vs", "versus", "near", "like", "to", "in", "on")

# Ranks and weights of severities.
SEVERITIES = {"critical": (0, 8), "high": (1, 4), "low": (2, 1), "info": (3, 0)}

# Agents asked about in robots files.
CITATION_BOTS = ("OAI-SearchBot", "ClaudeBot", "Claude-SearchBot", "PerplexityBot")

OTHER_BOTS = (
    "GPTBot", "Google-Extended", "CCBot", "anthropic-ai", "Applebot-Extended", "Bytespider", "Amazonbot", "meta-externalagent", "cohere-ai", "Diffbot",
    "ImagesiftBot", "Omgilibot", "PetalBot", "YouBot", "Timpibot",
)

# Types of structured data that describe the page itself.
PAGE_TYPES = (
    "Article", "NewsArticle", "BlogPosting", "WebPage", "ItemPage", "CollectionPage", "AboutPage", "ContactPage", "ProfilePage", "QAPage", "FAQPage", "Product",
    "Recipe", "HowTo", "Event", "JobPosting", "Course", "SoftwareApplication", "VideoObject", "Dataset",
)

# Properties that a type of structured data must and should have.
SCHEMA_RULES = {
    "Article": (["headline"], ["author", "datePublished", "image", "dateModified"]),
    "NewsArticle": (["headline"], ["author", "datePublished", "image", "dateModified"]),
    "BlogPosting": (["headline"], ["author", "datePublished", "image", "dateModified"]),
    "Product": (["name"], ["image", "description", "offers", "aggregateRating", "brand"]),
    "Offer": (["price", "priceCurrency"], ["availability", "url"]),
    "FAQPage": (["mainEntity"], []),
    "Question": (["name", "acceptedAnswer"], []),
    "HowTo": (["name", "step"], ["totalTime", "image"]),
    "Recipe": (["name"], ["image", "recipeIngredient", "recipeInstructions", "cookTime", "nutrition"]),
    "Event": (["name", "startDate", "location"], ["endDate", "offers", "performer", "eventStatus"]),
    "Organization": (["name"], ["url", "logo", "sameAs"]),
    "LocalBusiness": (["name", "address"], ["telephone", "openingHours", "geo", "priceRange"]),
    "Person": (["name"], ["url", "sameAs", "jobTitle"]),
    "BreadcrumbList": (["itemListElement"], []),
    "VideoObject": (["name", "thumbnailUrl", "uploadDate"], ["description", "duration", "contentUrl", "transcript"]),
    "SoftwareApplication": (["name"], ["applicationCategory", "operatingSystem", "offers", "aggregateRating"]),
    "Review": (["reviewRating", "author"], ["itemReviewed"]),
    "AggregateRating": (["ratingValue"], ["reviewCount", "ratingCount"]),
    "WebSite": (["name"], ["url", "potentialAction"]),
    "WebPage": ([], ["name", "description", "datePublished"]),
    "Dataset": (["name", "description"], ["license", "creator", "distribution"]),
    "JobPosting": (["title", "description", "datePosted", "hiringOrganization"], ["jobLocation", "baseSalary", "employmentType"]),
    "Course": (["name", "description"], ["provider", "offers", "hasCourseInstance"]),
}

# Prices of the services that remedies call.
PRICES = {
    "site.audit": 0.10, "site.graph": 0.10, "site.sitemap": 0.02, "site.aeo": 0.20, "page.audit": 0.01, "page.asai": 0.02, "page.blocked": 0.01,
    "page.aeo": 0.02, "geo.score": 0.02, "schema.validate": 0.005, "robots.check": 0.005, "llms.check": 0.005, "ai.visibility": 0.10,
    "ai.brand": 0.10, "ai.citations": 0.10, "ai.prompts": 0.05, "kw.discover": 0.01, "kw.questions": 0.02, "kw.demand": 0.02, "kw.cluster": 0.02,
    "content.audit": 0.05, "content.brief": 0.10, "content.charts": 0.05, "links.inbound": 0.10, "corpus.presence": 0.05, "compete.compare": 0.15,
    "audit.diff": 0.02, "report.pdf": 0.05,
}

# Remedies, as the prefixes of the codes they answer and the services they call.
REMEDIES = (
    ("crawler access", ("robots.ai_disallowed", "robots.disallowed", "aicrawler.blocked", "aicrawler.baseline_unavailable", "robots_citation_ok", "robots_found"), ("robots.check", "page.blocked")),
    ("server rendering", ("asai.js_required", "asai.mostly_js", "asai.partly_js"), ("page.asai", "site.audit")),
    ("duplicates", ("site.duplicate_title", "site.duplicate_content", "site.duplicate_description"), ("site.audit", "audit.diff")),
    ("structure", ("site.orphan_pages", "site.broken_internal_links", "site.canonical", "site.redirect", "site.too_deep", "graph.unlinked", "graph.dead_ends", "sitemap."), ("site.graph", "site.sitemap", "site.audit")),
    ("structured data", ("schema.", "schema_", "social."), ("schema.validate", "content.charts")),
    ("metadata", ("title.", "description.", "canonical.", "meta_", "viewport.", "language."), ("page.audit", "site.audit")),
    ("writing", ("aeo.", "chunk.", "evidence.", "readability.", "content.thin", "content_", "clutter."), ("page.aeo", "content.audit", "content.brief")),
    ("entity", ("brand_", "author.missing", "links.inbound"), ("links.inbound", "corpus.presence", "ai.brand")),
    ("machine files", ("llms.", "llms_", "ai_discovery", "signals_", "freshness.undated"), ("llms.check", "geo.score")),
)

# Response headers by which anti-bot services are known, and what they must hold.
CHALLENGE_HEADERS = (
    ("Vercel", "x-vercel-mitigated", "challenge"), ("Cloudflare", "cf-mitigated", "challenge"), ("Imperva Incapsula", "x-iinfo", ""), ("DataDome", "x-datadome", ""), ("DataDome", "x-dd-b", ""), ("AWS WAF", "x-amzn-waf-action", ""),
)

# Texts of their pages, in any case; the last two name no service.
CHALLENGE_BODIES = (
    ("Vercel", r"Vercel Security Checkpoint"),
    ("Cloudflare", r"<title>\s*Just a moment"),
    ("Cloudflare", r"Attention Required!\s*\|\s*Cloudflare"),
    ("Cloudflare", r"cf-browser-verification|cf_chl_opt|challenge-platform"),
    ("Cloudflare", r"Checking your browser before accessing"),
    ("Imperva Incapsula", r"Incapsula incident ID|_Incapsula_Resource"),
    ("DataDome", r"datadome|dd_?cookie|geo\.captcha-delivery\.com"),
    ("PerimeterX / HUMAN", r"px-captcha|_pxhd|perimeterx"),
    ("Akamai", r"(?s)Access Denied.{0,400}Reference\s*#\d|ak_bmsc|_abck"),
    ("Sucuri", r"Sucuri WebSite Firewall|sucuri_cloudproxy"),
    ("AWS WAF", r"Request blocked\.\s*We can't connect to the server"),
    ("Kasada", r"kpsdk|kasada"),
    ("Queue-it", r"queue-it\.net"),
    ("", r"(?:enable javascript|javascript is required)[^<]{0,80}(?:to continue|to view this)"),
    ("", r"(?:verifying|checking) (?:that )?you(?:r browser)?\s*(?:are|is)?[^<]{0,40}human"),
)
CAPTCHA = r"g-recaptcha|hcaptcha|turnstile|recaptcha/api\.js|challenges\.cloudflare\.com"
