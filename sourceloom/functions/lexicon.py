"""Word lists, place names, outlets and codes that results depend on, stated as they are."""

from __future__ import annotations

# Query parameters that only track.
TRACKING_PARAMS = (
    "gclid dclid fbclid msclkid twclid igshid yclid mc_cid mc_eid _ga _gl ref_src ref_url cmpid ocid sr_share smid spm share fromrss rss"
).split()

# Words left out of title tokens.
TITLE_STOPWORDS = (
    "a an and are as at be by for from has have how in into is it its of on or that the this to was were what "
    "when where which who why will with after about over new says said"
).split()

# Words of business headlines that don't identify a story.
GENERIC_WORDS = (
    "startup company companie firm raise raised raising secure secures land lands bag bags close closes funding fundraise fundraising round "
    "seed series pre-seed valuation valued unicorn statu become becomes hit hits announce announces launch launches investment investor invest "
    "back backed led lead million billion report news update week weekly daily today year first"
).split()

# Words of a question that name the kind of answer, not the topic.
NON_TOPIC_WORDS = (
    "a an and are as at be by for from has have how in into is it its of on or that the this to was were what when where which who why will with "
    "about across major main key recent latest new emerging current top best leading research identify find analyze analyse overview list "
    "company companies startup startups firm firms business businesses market markets industry industries sector sectors landscape player players "
    "ecosystem trend trends development developments news update updates funding round rounds investment investments investor investors "
    "raise raised raising"
).split()

# Words left out of search keywords.
KEYWORD_STOPWORDS = (
    "a an and are as at be by for from has have in into is it its of on or that the this to was were will with "
    "about across major main key recent latest new emerging current top best leading research identify find "
    "analyze analyse overview list companies company developments trends trend market markets"
).split()

# Acronyms that are topics although short.
ACRONYMS = "ai ml ev vr ar xr 5g 6g 3d iot b2b b2c saas llm api hr rpa nft".split()

# Other ways to write a topic.
VARIANTS = {
    "cybersecurity": ["cyber security", "cyber-security", "infosec", "cyber"],
    "fintech": ["fin-tech", "financial technology", "payments", "neobank", "lending"],
    "healthtech": ["health tech", "health-tech", "digital health"],
    "edtech": ["ed-tech", "education technology"],
    "proptech": ["prop-tech", "real estate tech"],
    "insurtech": ["insurance tech", "insur-tech"],
    "cleantech": ["clean tech", "climate tech", "climatetech"],
    "ai": ["artificial intelligence", "a.i.", "genai", "generative ai", "machine learning", "llm"],
    "robotic": ["robot", "robots", "robotics", "humanoid"],
}

# Hosts of job boards.
JOB_HOSTS = "naukri.com indeed.com glassdoor.com monster.com ambitionbox.com workinstartups.com".split()

# Words for the people and things of a country.
DEMONYMS = {
    "india": ["indian"], "united kingdom": ["british", "uk", "english", "scottish"], "united states": ["american", "us", "u.s."],
    "germany": ["german"], "france": ["french"], "italy": ["italian"], "spain": ["spanish"], "netherlands": ["dutch"],
    "sweden": ["swedish"], "denmark": ["danish"], "norway": ["norwegian"], "finland": ["finnish"], "ireland": ["irish"],
    "israel": ["israeli"], "switzerland": ["swiss"], "austria": ["austrian"], "belgium": ["belgian"], "poland": ["polish"],
    "estonia": ["estonian"], "portugal": ["portuguese"], "nigeria": ["nigerian"], "kenya": ["kenyan"], "south africa": ["south african"],
    "egypt": ["egyptian"], "brazil": ["brazilian"], "mexico": ["mexican"], "canada": ["canadian"], "australia": ["australian"],
    "singapore": ["singaporean"], "japan": ["japanese"], "china": ["chinese"], "south korea": ["korean", "south korean"],
    "indonesia": ["indonesian"], "united arab emirates": ["emirati", "uae"], "saudi arabia": ["saudi"], "hungary": ["hungarian"],
    "czech republic": ["czech"], "czechia": ["czech"], "slovakia": ["slovak"], "romania": ["romanian"], "ukraine": ["ukrainian"],
    "turkey": ["turkish"], "argentina": ["argentine", "argentinian"], "colombia": ["colombian"], "chile": ["chilean"],
    "new zealand": ["new zealander", "kiwi"], "lithuania": ["lithuanian"], "latvia": ["latvian"], "greece": ["greek"],
    "bulgaria": ["bulgarian"], "croatia": ["croatian"], "serbia": ["serbian"], "luxembourg": ["luxembourgish"],
}

# Other names of countries.
COUNTRY_ALIASES = {
    "usa": "united states", "us": "united states", "united states of america": "united states", "america": "united states",
    "uk": "united kingdom", "great britain": "united kingdom", "britain": "united kingdom", "england": "united kingdom",
    "uae": "united arab emirates", "korea": "south korea", "holland": "netherlands",
}

# Cities that stand for a country.
CITIES = {
    "germany": ["berlin", "munich", "münchen", "hamburg", "frankfurt", "cologne", "köln", "stuttgart", "darmstadt", "heidelberg", "karlsruhe", "dresden", "leipzig"],
    "india": ["bengaluru", "bangalore", "mumbai", "delhi", "new delhi", "gurugram", "gurgaon", "hyderabad", "pune", "chennai", "noida", "kolkata", "ahmedabad"],
    "japan": ["tokyo", "osaka", "kyoto", "yokohama", "nagoya", "fukuoka"],
    "united kingdom": ["london", "manchester", "edinburgh", "cambridge", "oxford", "bristol", "leeds"],
    "france": ["paris", "lyon", "marseille", "toulouse", "nantes"],
    "united states": ["san francisco", "silicon valley", "new york", "boston", "seattle", "austin", "los angeles"],
    "netherlands": ["amsterdam", "rotterdam", "eindhoven", "utrecht"],
    "spain": ["madrid", "barcelona", "valencia"], "italy": ["milan", "rome", "turin"], "sweden": ["stockholm", "gothenburg"],
    "switzerland": ["zurich", "zürich", "geneva", "lausanne"], "israel": ["tel aviv", "jerusalem", "haifa"],
    "nigeria": ["lagos", "abuja"], "kenya": ["nairobi"], "egypt": ["cairo", "alexandria"], "brazil": ["são paulo", "sao paulo", "rio de janeiro"],
    "singapore": [], "canada": ["toronto", "montreal", "vancouver"], "australia": ["sydney", "melbourne", "brisbane"],
    "south korea": ["seoul"], "china": ["beijing", "shanghai", "shenzhen"], "united arab emirates": ["dubai", "abu dhabi"],
    "estonia": ["tallinn"], "denmark": ["copenhagen"], "finland": ["helsinki"], "ireland": ["dublin"], "portugal": ["lisbon", "porto"],
    "poland": ["warsaw", "krakow", "kraków"], "austria": ["vienna"], "belgium": ["brussels", "antwerp"], "south africa": ["cape town", "johannesburg"],
}

# Regions, each with the words for it and the countries in it.
REGIONS = {
    "europe": {
        "words": ["europe", "european", "eu", "emea"],
        "countries": [
            "germany", "france", "italy", "spain", "netherlands", "sweden", "denmark", "norway", "finland", "ireland", "switzerland",
            "austria", "belgium", "poland", "estonia", "portugal", "united kingdom", "czechia", "slovakia", "romania", "ukraine",
            "hungary", "lithuania", "latvia", "greece", "bulgaria", "croatia", "serbia", "luxembourg",
        ],
    },
    "africa": {"words": ["africa", "african"], "countries": ["nigeria", "kenya", "egypt", "south africa"]},
    "latin america": {"words": ["latin america", "latam", "latin american"], "countries": ["brazil", "mexico", "argentina", "colombia", "chile"]},
    "asia": {"words": ["asia", "asian", "apac"], "countries": ["india", "japan", "china", "singapore", "south korea", "indonesia"]},
    "middle east": {"words": ["middle east", "mena", "gulf"], "countries": ["united arab emirates", "saudi arabia", "israel", "egypt", "turkey"]},
}
REGION_WORDS = {name: region["words"] for name, region in REGIONS.items()}
REGION_COUNTRIES = {name: region["countries"] for name, region in REGIONS.items()}

# News sites that are searched by their feeds (id, name, base address).
FEED_SITES = (
    ("techcrunch", "TechCrunch", "https://techcrunch.com"), ("crunchbase-news", "Crunchbase News", "https://news.crunchbase.com"),
    ("inc42", "Inc42", "https://inc42.com"), ("startup-daily", "Startup Daily", "https://www.startupdaily.net"),
    ("techcabal", "TechCabal", "https://techcabal.com"), ("securityweek", "SecurityWeek", "https://www.securityweek.com"),
    ("uktech-news", "UKTN", "https://www.uktech.news"),
)
# Display names of further outlets by host; home places of regional outlets.
OUTLETS = {base.split("//")[1].removeprefix("www."): name for _, name, base in FEED_SITES} | {
    "eu-startups.com": "EU-Startups", "tech.eu": "Tech.eu", "sifted.eu": "Sifted",
}
OUTLET_PLACES = {
    "inc42.com": "india", "startupdaily.net": "australia", "techcabal.com": "africa", "eu-startups.com": "europe",
    "tech.eu": "europe", "sifted.eu": "europe", "yourstory.com": "india", "uktech.news": "united kingdom",
}

# Named character references that are decoded.
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "hellip": "…", "mdash": "—", "ndash": "–", "lsquo": "‘",
    "rsquo": "’", "ldquo": "“", "rdquo": "”", "euro": "€", "pound": "£", "yen": "¥", "cent": "¢", "copy": "©", "reg": "®", "trade": "™", "deg": "°",
}

# Second-level labels under which organisations register.
SECOND_LEVEL = (
    "co.uk org.uk ac.uk com.au net.au org.au co.in net.in org.in firm.in com.br com.mx com.ar co.za com.ng co.ke com.eg com.sg com.my co.id "
    "co.jp co.kr com.cn com.hk com.tw co.nz com.tr co.il com.sa ae.org"
).split()

# Words that companies drop from names - one list for domains, one for name keys - and words domains add.
DOMAIN_SUFFIX_WORDS = "inc ltd limited llc gmbh ag sa sas srl spa plc bv nv pvt private corp corporation co company group holding holdings technologies technology tech lab labs payment payments ai hq".split()
NAME_SUFFIX_WORDS = "inc ltd limited llc gmbh ag sa sas srl spa plc bv nv pvt private corp corporation company group holding holdings".split()
DOMAIN_AFFIXES = "get try use join hq app inc group tech pay payments global labs ai io official online club finance capital security cyber health bank money".split()

# Sites that are nobody's own website.
NOT_OFFICIAL = (
    "wikipedia.org wikidata.org linkedin.com crunchbase.com tracxn.com pitchbook.com cbinsights.com facebook.com instagram.com x.com twitter.com "
    "youtube.com tiktok.com reddit.com medium.com bloomberg.com reuters.com techcrunch.com forbes.com glassdoor.com indeed.com ambitionbox.com "
    "zaubacorp.com tofler.in dealroom.co f6s.com wellfound.com angel.co g2.com capterra.com apps.apple.com apple.com play.google.com google.com "
    "yahoo.com bing.com github.com eu-startups.com inc42.com yourstory.com economictimes.indiatimes.com indiatimes.com zoominfo.com owler.com "
    "craft.co rocketreach.co similarweb.com trustpilot.com"
).split()

# Country codes of domains, for suggestions and for verification; codes used as general ones.
COUNTRY_TLD = {
    "india": "in", "germany": "de", "united kingdom": "uk", "united states": "us", "france": "fr", "italy": "it", "spain": "es",
    "netherlands": "nl", "sweden": "se", "denmark": "dk", "norway": "no", "finland": "fi", "ireland": "ie", "israel": "il",
    "switzerland": "ch", "austria": "at", "belgium": "be", "poland": "pl", "estonia": "ee", "portugal": "pt", "nigeria": "ng",
    "kenya": "ke", "south africa": "za", "egypt": "eg", "brazil": "br", "mexico": "mx", "canada": "ca", "australia": "au",
    "singapore": "sg", "japan": "jp", "china": "cn", "south korea": "kr", "indonesia": "id", "united arab emirates": "ae",
    "saudi arabia": "sa", "hungary": "hu", "czechia": "cz", "czech republic": "cz", "slovakia": "sk", "romania": "ro",
    "ukraine": "ua", "turkey": "tr", "argentina": "ar", "colombia": "co", "chile": "cl", "new zealand": "nz",
}
TLD_COUNTRY = {
    "in": "india", "de": "germany", "jp": "japan", "uk": "united kingdom", "fr": "france", "it": "italy", "es": "spain", "nl": "netherlands",
    "se": "sweden", "dk": "denmark", "fi": "finland", "no": "norway", "ch": "switzerland", "at": "austria", "be": "belgium", "pl": "poland",
    "ee": "estonia", "pt": "portugal", "ie": "ireland", "il": "israel", "ng": "nigeria", "ke": "kenya", "za": "south africa", "eg": "egypt",
    "br": "brazil", "mx": "mexico", "ca": "canada", "au": "australia", "sg": "singapore", "kr": "south korea", "cn": "china", "ae": "united arab emirates",
}
GENERIC_TLDS = "io ai co me tv gg ly so to sh cc fm ws vc".split()

# Classes of organisations in the knowledge base, that of listed companies, and words left out of contexts.
ORG_CLASSES = "Q4830453 Q783794 Q6881511 Q891723 Q1589009 Q18388277 Q1058914 Q43229 Q22687 Q650241 Q658255 Q20074337 Q167037 Q2085381 Q17127659".split()
PUBLIC_COMPANY = "Q891723"
CONTEXT_STOPWORDS = "the and for with company companies startup startups platform based services service provider in of".split()

# Outlets whose coverage counts, and press wires, which don't.
REPUTABLE = (
    "reuters.com bloomberg.com ft.com wsj.com nytimes.com economist.com cnbc.com fortune.com forbes.com techcrunch.com theinformation.com "
    "apnews.com bbc.com bbc.co.uk theguardian.com wired.com theverge.com axios.com businessinsider.com venturebeat.com euronews.com nikkei.com "
    "japantimes.co.jp handelsblatt.com lesechos.fr sifted.eu tech.eu eu-startups.com crunchbase.com inc42.com yourstory.com indiatimes.com "
    "techcabal.com startupdaily.net siliconrepublic.com securityweek.com restofworld.org fastcompany.com"
).split()
WIRES = "globenewswire.com prnewswire.com businesswire.com".split()
ENTITY_TYPES = "startup established_company investor partner research_institution other".split()
CONSTRAINT_TYPES = "startup established_company investor research_institution any".split()
LABELS = "direct contextual irrelevant".split()
STATUSES = "pending planning collecting processing analyzing resolving completed failed".split()
