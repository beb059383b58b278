"""What is known of single brands: names as people write them, and industries that no page needs to be read for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as X

# Names that listings run together, and how they are searched for.
NAMES = {
    "B&HPhoto": "B&H Photo", "Crate&Barrel": "Crate and Barrel", "DeltaAirLines": "Delta Air Lines", "HannaAndersson": "Hanna Andersson", "DavidYurman": "David Yurman", "HolabirdSports": "Holabird Sports",
    "AcademySports+Outdoors": "Academy Sports Outdoors", "BestBuy": "Best Buy", "FootLocker": "Foot Locker", "GameStop": "GameStop", "EsteeLauder": "Estee Lauder", "EcoFlowTech": "EcoFlow Tech",
    "DoMyOwnPestControl.com": "Do My Own Pest Control", "BBQGuys": "BBQ Guys", "FARFETCH": "Farfetch", "LeLaboFragrances": "Le Labo Fragrances", "L.L.Bean": "L.L.Bean", "Lowe'sHomeImprovement": "Lowe's Home Improvement",
    "Madewell": "Madewell", "Moreinformationaboutourcookiepolicy": "More information about our cookie policy", "Nespresso": "Nespresso", "NewBalanceRunning": "New Balance Running", "OfficeDepot": "Office Depot",
    "OuraRing": "Oura Ring", "PopSockets": "PopSockets", "RoomsToGoInc.": "Rooms To Go", "SaksFifthAvenue": "Saks Fifth Avenue", "SaksOFF5TH": "Saks OFF 5TH", "Shopnow": "Shop now", "Shutterfly": "Shutterfly",
    "SixFlags": "Six Flags", "Skiptomaincontent": "Skip to main content", "SouthwestAirlines": "Southwest Airlines", "SurLaTable": "Sur La Table", "TPSGARAGELLC": "TPS Garage LLC", "TheLEGO": "LEGO",
    "ThePro'sCloset,Inc.": "The Pro's Closet", "TOMSShoes": "TOMS Shoes", "UnitedAirlines": "United Airlines", "WilliamsSonoma": "Williams Sonoma", "WilsonSportingGoods": "Wilson Sporting Goods", "DoorDash": "DoorDash",
    "GoogleStore": "Google Store", "Booking.com": "Booking.com", "StubHub": "StubHub", "Shop.app": "Shop app", "T-Mobile": "T-Mobile", "Zara": "Zara",
}

# Keys of brands with their industries.
BRANDS = {
    "mercari": ("Marketplace / General Retail", "Marketplace"),
    "saksfifthavenue": ("Marketplace / General Retail", "Department store / omnichannel retail"),
    "saksoff5th": ("Marketplace / General Retail", "Department store / omnichannel retail"),
    "sephora": ("Beauty & Personal Care", "Cosmetics / makeup"),
    "pureology": ("Beauty & Personal Care", "Haircare"),
    "therollingstonesofficialstore": ("Entertainment / Music", "Music artist merchandise / fan shop"),
    "zales": ("Apparel & Fashion", "Jewelry & watches"),
    "googlestore": ("Electronics", "Consumer electronics"),
    "shopapp": ("Marketplace / General Retail", "Shopping platform / app"),
    "stubhub": ("Travel & Ticketing", "Event tickets"),
    "bookingcom": ("Travel & Ticketing", "Travel booking / lodging marketplace"),
    "thelego": ("Baby & Kids", "Toys"),
    "lego": ("Baby & Kids", "Toys"),
    "llbean": ("Sports & Outdoor", "Outdoor apparel & gear"),
    "rei": ("Sports & Outdoor", "Outdoor apparel & gear"),
    "patagonia": ("Sports & Outdoor", "Outdoor apparel & gear"),
    "newbalancerunning": ("Sports & Outdoor", "Athletic footwear & apparel"),
    "newbalance": ("Sports & Outdoor", "Athletic footwear & apparel"),
    "nike": ("Sports & Outdoor", "Athletic footwear & apparel"),
    "nobull": ("Sports & Outdoor", "Athletic footwear & apparel"),
    "lululemon": ("Sports & Outdoor", "Athletic footwear & apparel"),
    "vans": ("Apparel & Fashion", "Footwear"),
    "macys": ("Marketplace / General Retail", "Department store / omnichannel retail"),
    "lowes": ("Home & Furniture", "Home improvement / hardware"),
    "loweshomeimprovement": ("Home & Furniture", "Home improvement / hardware"),
    "publix": ("Food & Grocery", "Grocery"),
    "tcgplayer": ("Marketplace / General Retail", "Collectibles / trading cards marketplace"),
    "lelabo": ("Beauty & Personal Care", "Fragrance"),
    "lelabofragrances": ("Beauty & Personal Care", "Fragrance"),
}


def brand_key(*names: Column, brands: dict[str, tuple[str, str]] | None = None) -> Column:
    """The first key of a row's names, or else of their search forms, that is a brand's; null if none is."""
    known = F.array(*map(F.lit, BRANDS if brands is None else brands))
    keys = F.array(*[X.key_plain(n) for n in names], *[X.key_plain(X.friendly_name(n, NAMES)) for n in names])
    return F.get(F.filter(keys, lambda k: F.array_contains(known, k)), F.lit(0))


def industry(key: Column, brands: dict[str, tuple[str, str]] | None = None) -> Column:
    """Struct of a brand key's broad and sub industry; null for any other key. Looked up in the plan, without a join."""
    table = F.create_map(*[x for k, (broad, sub) in (BRANDS if brands is None else brands).items() for x in (F.lit(k), F.struct(F.lit(broad).alias("broad"), F.lit(sub).alias("sub")))])
    return F.try_element_at(table, key)


def overridden(found: dict[str, Column], *names: Column) -> Column:
    """Struct of broad, sub, confidence, reason and needs_review after a brand's own industry; found names these five columns.

    A row that has the brand's industry already, surely and without a review, stays as it is, as does one of no brand.
    """
    key = brand_key(*names)
    to = industry(key)
    same = F.coalesce((found["broad"] == to["broad"]) & (found["sub"] == to["sub"]) & (found["confidence"] == "high") & ~found["needs_review"], F.lit(False))
    use = key.isNotNull() & ~same
    was = F.concat(F.lit("exact brand "), key, F.lit("; before: "), F.concat_ws(" / ", found["broad"], found["sub"], found["confidence"]), F.lit("; "), F.coalesce(found["reason"], F.lit("")))
    new = {"broad": to["broad"], "sub": to["sub"], "confidence": F.lit("high"), "reason": was, "needs_review": F.lit(False)}
    return F.struct(*[F.when(use, new[c]).otherwise(found[c]).alias(c) for c in new])
