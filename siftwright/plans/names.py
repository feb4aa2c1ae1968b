"""Display names that claim a brand or an organisation the address has nothing to do with."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwright.functions.domains import domain_of, org_domain
from siftwright.plans.detect import findings_of, hit, union

# Brands, the words that name them, and their own domains; providers whose addresses anybody can have.
BRANDS = (
    ("microsoft", "Microsoft|Office 365|Microsoft 365|OneDrive|SharePoint|Microsoft Teams", "microsoft.com office.com office365.com outlook.com live.com microsoftonline.com sharepoint.com onedrive.com microsoft365.com"), ("paypal", "PayPal", "paypal.com"), ("apple", "Apple|iCloud|Apple ID|iTunes", "apple.com icloud.com"),
    ("amazon", "Amazon|AWS", "amazon.com amazonaws.com"), ("google", "Google|Gmail|Google Workspace", "google.com gmail.com googlemail.com"), ("facebook", "Facebook|Meta|Instagram|WhatsApp", "facebook.com facebookmail.com meta.com instagram.com whatsapp.com"), ("linkedin", "LinkedIn", "linkedin.com"), ("netflix", "Netflix", "netflix.com"),
    ("dhl", "DHL", "dhl.com"), ("fedex", "FedEx", "fedex.com"), ("ups", "UPS", "ups.com"), ("usps", "USPS", "usps.com"), ("docusign", "DocuSign", "docusign.com docusign.net"), ("dropbox", "Dropbox", "dropbox.com"), ("adobe", "Adobe|Adobe Sign|Acrobat", "adobe.com adobesign.com"), ("wellsfargo", "Wells Fargo", "wellsfargo.com"),
    ("chase", "Chase Bank|JPMorgan Chase", "chase.com jpmorgan.com"), ("bankofamerica", "Bank of America", "bankofamerica.com bofa.com"), ("citibank", "Citibank", "citibank.com citi.com"), ("hsbc", "HSBC", "hsbc.com"), ("americanexpress", "American Express|Amex", "americanexpress.com aexp.com"), ("coinbase", "Coinbase", "coinbase.com"),
    ("binance", "Binance", "binance.com"), ("metamask", "MetaMask", "metamask.io"), ("spotify", "Spotify", "spotify.com"), ("yahoo", "Yahoo", "yahoo.com yahoo-inc.com"), ("att", "AT&T", "att.com att.net"), ("verizon", "Verizon", "verizon.com"), ("irs", "IRS|Internal Revenue Service", "irs.gov"), ("walmart", "Walmart", "walmart.com"),
    ("ebay", "eBay", "ebay.com"), ("norton", "Norton 360|Norton Antivirus|NortonLifeLock", "norton.com gen.com"), ("mcafee", "McAfee", "mcafee.com"), ("geeksquad", "Geek Squad", "geeksquad.com bestbuy.com"), ("okta", "Okta", "okta.com"), ("salesforce", "Salesforce", "salesforce.com"), ("intuit", "Intuit|QuickBooks|TurboTax", "intuit.com quickbooks.com turbotax.com"),
    ("booking", "Booking.com", "booking.com"), ("airbnb", "Airbnb", "airbnb.com"), ("zoom", "Zoom Video|Zoom Meetings", "zoom.us zoom.com"),
)
FREE = "gmail.com googlemail.com outlook.com hotmail.com live.com msn.com yahoo.com ymail.com aol.com icloud.com me.com mac.com proton.me protonmail.com gmx.com gmx.de gmx.net web.de mail.com mail.ru yandex.ru yandex.com zoho.com tutanota.com tuta.io qq.com 163.com 126.com".split()


def brand_domains(spark) -> DataFrame:
    """(domain, kind): the brands' own domains, as a protected list."""
    return spark.createDataFrame([(d, "brand") for _, _, ds in BRANDS for d in ds.split()], "domain string, kind string")


def brands(spark) -> DataFrame:
    """(ord, brand, pattern, own): a row for each word; short names in capitals are matched as they are."""
    rows = []
    for i, (brand, words, own) in enumerate(BRANDS):
        for w in words.split("|"):
            flag = "" if w.isupper() and len(w) <= 5 else "(?iu)"
            rows.append((i, brand, rf"{flag}(?<![\w&])\Q{w}\E(?![\w&])", own.split()))
    return spark.createDataFrame(rows, "ord int, brand string, pattern string, own array<string>")


def impersonation(messages: DataFrame, own_orgs: DataFrame | None = None) -> DataFrame:
    """The first brand a display name claims, if the address isn't the brand's; else an organisation of ``own_orgs(domain)``.

    Names are made distinct, and meet the brand words in a join with a fixed list.
    """
    spark = messages.sparkSession
    org = org_domain(spark)
    m = messages.select("report_id", "from_display_name", org(domain_of(F.col("from_address"))).alias("org")).filter("from_display_name <> '' and org is not null")
    names = m.select("from_display_name").distinct()
    claims = names.join(F.broadcast(brands(spark)), F.expr("regexp_like(from_display_name, pattern)")).groupBy("from_display_name").agg(F.min_by(F.struct("brand", "own"), "ord").alias("c"))
    m = m.join(claims, "from_display_name", "left").withColumn("free", F.col("org").isin(FREE))
    label = F.substring_index("org", ".", 1)
    is_own = ~F.col("free") & (F.array_contains("c.own", F.col("org")) | F.exists(F.col("c.own"), lambda d: F.substring_index(d, ".", 1) == label))
    worse = F.when(F.col("free"), "high").otherwise("medium")
    parts = [findings_of(m, hit(F.col("c").isNotNull() & ~is_own, "HDR_DISPLAY_NAME_BRAND", worse, None, brand=F.col("c.brand")))]
    if own_orgs is not None:
        o = own_orgs.select("domain", F.substring_index("domain", ".", 1).alias("name")).filter("length(name) >= 4").distinct()
        words = names.select("from_display_name", F.explode(F.array_distinct(F.split(F.lower("from_display_name"), r"[^\p{L}\p{N}-]+"))).alias("name"))
        pairs = words.join(o, "name").groupBy("from_display_name").agg(F.min("domain").alias("imitates"))
        rest = m.filter("c is null").join(pairs, "from_display_name").filter("org <> imitates")
        parts.append(findings_of(rest, hit(F.lit(True), "HDR_DISPLAY_NAME_ORG", worse, None, imitates=F.col("imitates"))))
    return union(parts)
