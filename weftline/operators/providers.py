"""Listing rules of five providers, for evidence.listings and evidence.first_seen."""

from __future__ import annotations

# What each provider's pages hold besides listings, and where its listings are.
AFFIRM = {
    "blocked": [
        "affirm", "shop", "help", "help center", "log in", "sign in", "sign up", "get started", "for shoppers", "for businesses", "business", "developers", "careers", "investors",
        "press", "security", "privacy", "terms", "licenses", "accessibility", "your privacy choices", "download the app", "check my purchasing power", "learn more", "see all", "load more",
    ],
    "longest": 80,
    "blocked_parts": ["/help", "/business", "/careers", "/investors", "/press", "/licenses", "/terms", "/privacy", "support.apple.com", "fdic.gov"],
    "seen": ["low"],
}
KLARNA = {
    "blocked": [
        "klarna", "help", "about us", "careers", "privacy", "terms", "legal", "press", "security", "sign in", "for business", "for shoppers", "customer service", "business login",
        "developer portal", "all categories", "united states", "show more",
    ],
    "card": True,
    "letter": False,
    "signals": ["klarna at checkout", "shop in the klarna app", "google pay", "apple pay", "onepay later"],
    "path": "/us/store/",
    "seen": ["low", "link"],
}
AFTERPAY = {
    "blocked": [
        "stores", "retailer pages", "help", "guide", "afterpay access", "retailer resources", "how afterpay works", "all categories", "for retailers", "get the app", "login", "sign up",
        "account login", "privacy", "terms", "contact", "careers", "security", "licenses", "mobile app", "investors", "media", "about us", "partner program", "responsible spending",
        "installment agreement", "united states", "australia", "new zealand", "united kingdom", "canada - english", "canada - français",
    ],
    "letter": False,
    "hosts": ["www.afterpay.com", "afterpay.com"],
    "prefix": "/en-us/stores/",
    "last": "stores",
    "seen": ["low", "link"],
}
CLEARPAY = {
    "blocked": [
        "get the app", "how it works", "get the facts", "invite a friend", "help", "login", "sign up", "all categories", "most popular", "on sale", "new", "support small", "shop in-store",
        "support", "account login", "security", "contact us", "hardship", "single use payments", "gift cards", "clearpay card", "clearpay app", "google play", "app store", "resources",
        "clearpay access", "retailer resources", "clearpay api", "clearpay for business", "partner program", "location", "united states", "australia", "new zealand", "united kingdom",
        "canada - english", "canada - français", "about", "careers", "media", "investors", "general terms", "website terms", "cookies notice", "privacy", "cookie preferences",
        "modern slavery statement", "retailer pages", "categories", "all stores",
    ],
    "longest": 80,
    "letter": False,
    "plain": True,
    "blocked_parts": [
        "/help", "/security", "/contact", "/careers", "/media", "/investors", "/terms", "/privacy", "/cookies", "/partner-program", "/for-retailers", "/clearpay-api", "/retailer-resources",
        "/account", "portal.clearpay.co.uk", "developers.clearpay.co.uk", "play.google.com", "apps.apple.com", "instagram.com", "linkedin.com", "facebook.com", "x.com",
    ],
    "hosts": ["www.clearpay.co.uk", "clearpay.co.uk"],
    "prefix": "/en-GB/stores/",
    "shut": ["/en-GB/stores/retailer-pages"],
    "seen": ["key"],
}
ZIP = {
    "blocked": [
        "customers", "business", "for business", "how it works", "shop stores", "shop categories", "insights", "help", "products", "affiliate", "resource", "pricing",
        "change region from united states", "sign in", "sign up", "open mobile navigation", "customer sign in", "become a zip merchant", "merchant sign in", "merchant resources",
        "documentation", "api reference", "pci dss compliance", "about", "careers", "contact us", "investors", "press", "support", "privacy policy", "system status", "terms of service",
        "licenses", "vulnerability disclosure program", "home", "featured", "see all", "facebook", "twitter", "instagram", "linkedin", "0-9",
    ],
    "longest": 100,
    "letter": False,
    "single": False,
    "blocked_parts": [
        "/us/business", "/us/for-business", "/us/how-it-works", "/us/categories", "/us/insights", "/us/app", "/us/chrome", "/us/contact", "/us/about", "/us/careers", "/us/press",
        "/us/privacy", "/us/terms", "/us/licenses", "help.us.zip.co", "customer.us.zip.co", "merchant.us.zip.co", "docs.us.zip.co", "status.us.zip.co", "facebook.com", "twitter.com",
        "instagram.com", "linkedin.com",
    ],
    "hosts": ["zip.co", "www.zip.co"],
    "prefix": "/us/store/",
    "closed": ["/us/store/directory"],
    "seen": ["key", "link"],
}
#: Parts of domains that are no shop's own site, and the providers' domains.
BLOCKED_DOMAINS = [
    "facebook.", "instagram.", "linkedin.", "twitter.", "x.com", "tiktok.", "pinterest.", "youtube.", "reddit.", "wikipedia.", "wikidata.", "yelp.", "trustpilot.", "bbb.", "glassdoor.", "indeed.",
    "crunchbase.", "retailmenot.", "coupon", "shop.app", "linktr.ee", "linktree", "amazon.com", "ebay.com",
]
PROVIDER_DOMAINS = ["affirm.com", "klarna.com", "afterpay.com", "clearpay.co.uk", "zip.co"]

#: The rules of each provider by its name; a caller may pass others of the same form.
RULES = {"affirm": AFFIRM, "klarna": KLARNA, "afterpay": AFTERPAY, "clearpay": CLEARPAY, "zip": ZIP}
