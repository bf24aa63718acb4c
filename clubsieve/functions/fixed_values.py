"""Word lists, code tables, patterns and thresholds that results depend on.

Nothing here is logic. Each block must keep its values (and, where the first match wins,
its order) for results to stay comparable from run to run.
"""

# --- fixed values: season digit and two-digit sport number -------------------------------
SEASON_BY_DIGIT = {
    "1": "Spring", "2": "Summer", "3": "Fall", "4": "Winter", "5": "Spring/Summer",
    "6": "Fall/Winter", "7": "Tournament", "8": "Youth", "9": "Other",
}
SPORT_BY_NUMBER = {
    "01": "Soccer", "02": "Flag Football", "03": "Ultimate Frisbee", "04": "Rugby",
    "05": "Lacrosse", "06": "Cricket", "07": "Kickball", "08": "Field Hockey",
    "10": "Basketball", "11": "Volleyball", "12": "Badminton", "13": "Pickleball",
    "14": "Squash", "15": "Racquetball", "16": "Table Tennis",
    "20": "Beach Volleyball", "21": "Tennis", "22": "Pickleball Outdoor",
    "30": "Ice Hockey", "31": "Broomball", "32": "Curling", "33": "Figure Skating",
    "34": "Speed Skating", "35": "Roller Hockey",
    "40": "Baseball", "41": "Softball", "42": "Softball Fast Pitch", "43": "Wiffle Ball",
    "50": "Dodgeball", "51": "Indoor Soccer", "52": "Floor Hockey", "53": "Handball",
    "54": "Cornhole", "55": "Darts", "56": "Bowling", "57": "Axe Throwing",
    "60": "Swimming", "61": "Water Polo", "62": "Dragon Boat", "63": "Kayaking",
    "64": "Stand-Up Paddleboarding",
    "70": "Boxing", "71": "Kickboxing", "72": "Brazilian Jiu-Jitsu", "73": "Wrestling",
    "74": "Martial Arts", "75": "CrossFit", "76": "Bootcamp",
    "80": "Running Club", "81": "Triathlon", "82": "Cycling", "83": "Track & Field",
    "90": "Multi-Sport Social League", "91": "Yard Games", "92": "Esports", "93": "Chess",
    "94": "Poker League", "99": "Other",
}
SEASON_LABEL_PREFIXES = ("Late ", "Early ", "Mid ", "Mid-")

# --- fixed values: competition level labels ------------------------------------------------
LEVEL_BY_LABEL = {
    "competitive": "A", "a league": "A", "a": "A", "gold": "A", "premier": "A",
    "division 1": "A", "div 1": "A", "div a": "A", "elite": "A", "advanced": "A",
    "upper": "A", "prem": "A",
    "intermediate": "B", "b league": "B", "b": "B", "silver": "B", "division 2": "B",
    "div 2": "B", "div b": "B", "mid": "B", "middle": "B", "open": "B",
    "all skill levels": "B", "all levels": "B",
    "recreational": "C", "rec": "C", "c league": "C", "c": "C", "bronze": "C",
    "division 3": "C", "div 3": "C", "div c": "C", "house": "C", "social": "C",
    "beginner": "C", "lower": "C", "fun": "C",
    "d league": "D", "d": "D", "division 4": "D", "div 4": "D", "div d": "D", "novice": "D",
    "none found": "A",
}
LEVEL_BY_WORD = {
    "competitive": "A", "elite": "A", "premier": "A", "advanced": "A",
    "intermediate": "B", "inter": "B",
    "recreational": "C", "rec": "C",
    "novice": "D", "beginner": "C",
}
LEVEL_UP_WORDS = ("high", "upper", "plus", "advanced", "competitive")
LEVEL_DOWN_WORDS = ("low", "lower", "beginner", "really", "intro", "basic")
NO_LEVEL_LABEL, NO_LEVEL_GRADE = "None Found", "A"

# --- fixed values: city slugs, in order of precedence ----------------------------------------
CITY_BY_SLUG = {
    "ottawa": "Ottawa", "toronto": "Toronto", "guelph": "Guelph", "hamilton": "Hamilton",
    "kitchener": "Kitchener", "waterloo": "Waterloo", "london": "London", "windsor": "Windsor",
    "kingston": "Kingston", "barrie": "Barrie", "sudbury": "Sudbury",
    "thunder-bay": "Thunder Bay", "thunderbay": "Thunder Bay", "mississauga": "Mississauga",
    "brampton": "Brampton", "markham": "Markham", "richmond-hill": "Richmond Hill",
    "richmondhill": "Richmond Hill", "vaughan": "Vaughan", "oakville": "Oakville",
    "burlington": "Burlington", "oshawa": "Oshawa", "north-york": "North York",
    "northyork": "North York", "scarborough": "Scarborough", "etobicoke": "Etobicoke",
    "pickering": "Pickering", "ajax": "Ajax", "whitby": "Whitby",
    "peterborough": "Peterborough", "cambridge": "Cambridge", "brantford": "Brantford",
    "st-catharines": "St. Catharines", "stcatharines": "St. Catharines",
    "niagara": "Niagara", "niagara-falls": "Niagara Falls", "niagarafalls": "Niagara Falls",
    "calgary": "Calgary", "edmonton": "Edmonton", "red-deer": "Red Deer",
    "reddeer": "Red Deer", "lethbridge": "Lethbridge", "medicine-hat": "Medicine Hat",
    "vancouver": "Vancouver", "victoria": "Victoria", "kelowna": "Kelowna",
    "burnaby": "Burnaby", "surrey": "Surrey", "richmond": "Richmond",
    "abbotsford": "Abbotsford", "coquitlam": "Coquitlam",
    "montreal": "Montreal", "quebec": "Quebec City", "quebec-city": "Quebec City",
    "laval": "Laval", "longueuil": "Longueuil",
    "winnipeg": "Winnipeg", "regina": "Regina", "saskatoon": "Saskatoon",
    "halifax": "Halifax", "moncton": "Moncton", "fredericton": "Fredericton",
    "new-york": "New York", "newyork": "New York", "nyc": "New York", "chicago": "Chicago",
    "boston": "Boston", "seattle": "Seattle", "portland": "Portland", "denver": "Denver",
    "austin": "Austin", "dallas": "Dallas", "houston": "Houston", "phoenix": "Phoenix",
    "atlanta": "Atlanta", "miami": "Miami", "washington": "Washington", "dc": "Washington",
    "philadelphia": "Philadelphia", "minneapolis": "Minneapolis", "pittsburgh": "Pittsburgh",
    "cleveland": "Cleveland", "detroit": "Detroit", "san-francisco": "San Francisco",
    "sanfrancisco": "San Francisco", "los-angeles": "Los Angeles",
    "losangeles": "Los Angeles", "la": "Los Angeles", "san-diego": "San Diego",
    "sandiego": "San Diego",
}
PROVINCES = ("AB", "BC", "MB", "NB", "NL", "NS", "NT", "NU", "ON", "PE", "QC", "SK", "YT")

# --- fixed values: search-result screening -----------------------------------------------------
DOCUMENT_ENDINGS = (".pdf", ".doc", ".docx", ".jpg", ".png", ".xlsx", ".csv")
BLOCKED_HOSTS = (
    "facebook.com", "instagram.com", "twitter.com", "tiktok.com", "reddit.com", "yelp.com",
    "google.com", "maps.google.com", "wikipedia.org", "wikimedia.org", "youtube.com",
    "linkedin.com", "pinterest.com",
)
REVIEW_HOSTS = ("yelp.com", "maps.google.com")
PROFESSIONAL_WORDS = (
    "mls", "nba", "nfl", "nhl", "mlb", "wnba",
    "major league", "premier league", "la liga", "serie a",
    "canpl", "cpl", "cfl", "nll",
    "toronto fc", "tfc", "raptors", "maple leafs", "blue jays",
    "whitecaps", "impact", "cf montreal", "cavalry fc",
    ".canpl.ca", "mlssoccer.com", "nhl.com", "nba.com",
    "professional", "pro team", "ticket", "tickets", "box office",
)
YOUTH_WORDS = (
    "youth", "minor", "junior", "kids", "children",
    "u18", "u16", "u14", "u12", "u10", "u8", "u6",
    "district association", "district soccer", "district hockey",
    "academy", "development program", "rep team", "house league",
)
OFF_TOPIC_WORDS = (
    "news article", "blog post", "review", "article",
    "facility rental", "equipment shop", "sports bar", "gym",
)
ON_TOPIC_WORDS = ("league", "register", "schedule", "sign up", "team", "roster", "season")
ACCEPTED_HOST_ENDINGS = (".com", ".org", ".net", ".ca", ".io", ".app")
ADULT_WORDS = (
    "adult", "rec", "recreational", "coed", "co-ed",
    "social", "beer league", "mens", "womens", "mixed",
)
PRIORITY_WORDS = ("league", "register", "registration", "schedule")
KNOWN_ORGANISATIONS = (
    "TSSC", "VOLO", "ZOGSPORTS", "JAM", "JAMSPORTS", "UNDERDOG", "CLUBWAKA", "NAKID",
    "PLAYCSA", "OSSC", "OTTAWA", "KSSC", "MTLSPORTSOCIAL", "HFXSPORTSOCIAL", "VSSC", "CSSC",
    "ESSC", "SPORTANDSOCIALCLUB", "CAPITALVOLLEY", "OTTAWARECSPORTS", "OTTAWAVOLLEYSIXES",
    "JAVELINSPORTSINC", "OTTAWAFUSION", "RACENTRE", "XTSC", "DOWNTOWNSOCCERTORONTO",
    "TOSOCCERLEAGUE", "TOSOCCER",
)

# --- fixed values: files a page fetch leaves out --------------------------------------------------
UNFETCHABLE_ENDINGS = (
    ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".csv", ".zip", ".png", ".jpg", ".jpeg",
    ".gif", ".svg", ".mp4", ".mp3",
)

# --- fixed values: listing type rule ------------------------------------------------------------------
DROP_IN_PATTERN = r"drop.?in|pick.?up|one.?time|casual|social night|open play"
DROP_IN_PRICE_BELOW = 20
SEASON_MIN_WEEKS = 4
LISTING_TYPES = ("league", "drop_in", "unknown")

# --- fixed values: page type by path and by keyword --------------------------------------------------
PAGE_PATH_PATTERNS = {
    "registration": ("/register", "/registration", "/signup", "/sign-up", "/join", "/enroll"),
    "schedule": ("/schedule", "/schedules", "/matches", "/games", "/fixtures"),
    "standings": ("/standings", "/rankings", "/points", "/leaderboard", "/results"),
}
PAGE_TEXT_WORDS = {
    "registration": ("register", "sign up", "join", "enroll", "fee", "pricing", "cost",
                     "register now"),
    "schedule": ("schedule", "game", "match", "vs", "versus", "date", "time", "venue",
                 "fixture"),
    "standings": ("standing", "rank", "points", "wins", "losses", "gf", "ga", "draw"),
}
CATEGORY_PATH_PATTERNS = {
    "registration": r"(?:register|signup|sign-up|sign_up|registration|enroll|join|register-now)",
    "schedule": r"(?:schedule|schedules|calendar|times|games|matches|fixtures|calendar)",
    "standings": r"(?:standings|results|results|teams|roster|scores|leaderboard|ladder)",
    "specific_league": r"(?:league|division|sport|tournament|competition|season)s?(?:/\d+)?",
    "home": r"^/$|index|home|^$",
}
CATEGORY_WORDS = {
    "registration": ("register", "sign up", "signup", "fee", "cost", "price", "deadline",
                     "registration", "enroll", "join", "team registration"),
    "schedule": ("schedule", "game time", "match", "day", "time", "when", "fixture",
                 "calendar", "date", "kickoff", "start time"),
    "standings": ("standings", "points", "wins", "losses", "teams", "results", "record",
                  "ranking", "position", "leaderboard"),
    "specific_league": ("league", "division", "level", "competitive", "recreational",
                        "format", "rules", "tier", "bracket"),
    "home": (),
}
BUNDLE_PRIORITY = {
    "registration": 1, "schedule": 2, "standings": 3, "specific_league": 4, "home": 5, "other": 6,
}
LEGAL_LINE_PATTERN = r"(?i)copyright|©|all rights reserved|privacy|terms of service"
NAVIGATION_LINE_PATTERN = r"(?i)^(home|about|contact|login|search)$"

# --- fixed values: weights of scored page elements ---------------------------------------------------
ELEMENT_WORD_WEIGHTS = {
    "team fee": 1.2, "registration fee": 1.2, "individual fee": 1.1, "fee": 1.0, "price": 1.0,
    "cost": 0.9, "$": 0.8, "team count": 1.2, "teams": 1.0, "divisions": 0.9,
    "spots left": 1.1, "openings": 0.9, "capacity": 0.8, "venue": 1.0, "location": 0.9,
    "address": 0.8,
}
ELEMENT_TAG_WEIGHTS = {
    "table": 1.0, "tr": 0.9, "td": 0.8, "th": 0.9, "div": 0.6, "span": 0.5, "p": 0.4,
}
PRICE_WORDS = ("fee", "price", "cost", "registration fee", "team fee", "individual fee", "$")
PRICE_PATTERN = r"\$?\s*(\d+(?:,\d{3})*(?:\.\d{2})?)"
TEAM_COUNT_PATTERN = r"(?i)(\d+)\s*(?:teams?|divisions?|spots?|openings?)"
STANDINGS_TABLE_WORDS = ("standing", "rank", "team", "division")
TABLE_HEADER_WORDS = {
    "schedule": ("day", "time", "date", "when", "schedule", "start"),
    "venue": ("venue", "location", "gym", "field", "park", "address", "where"),
    "pricing": ("fee", "price", "cost", "team", "individual", "player"),
    "listing": ("division", "format", "level", "league", "type", "coed", "mens", "womens"),
}

# --- fixed values: link scoring ---------------------------------------------------------------------------
LINK_HIGH_PATTERNS = (
    r"(?:register|signup|sign-up|sign_up|registration|register\s+now)",
    r"(?:join|enroll|apply|get\s+started|create\s+account|buy\s+now)",
    r"(?:view\s+)?schedule",
    r"standings",
    r"results",
    r"league(?:\s+info)?",
    r"season",
)
LINK_MEDIUM_PATTERNS = (
    r"divisions?", r"teams?", r"rosters?", r"bracket(?:s)?", r"tournament", r"playoffs?",
    r"(?:game|match)(?:es)?", r"about\s+(?:the\s+)?league", r"how\s+to\s+(?:play|join)",
    r"fees?", r"pricing", r"rules?", r"format",
)
LINK_BLOCKED_HOSTS = (
    "facebook.com", "instagram.com", "twitter.com", "tiktok.com", "youtube.com", "reddit.com",
    "linkedin.com", "pinterest.com", "yelp.com", "google.com", "maps.google.com",
)
LINK_BLOCKED_PATHS = ("/login", "/admin", "/wp-admin", "/account", "/profile")
NAV_STRUCTURE_WORDS = (
    "register", "signup", "sign up", "registration",
    "schedule", "standings", "upcoming", "leagues", "games",
    "season", "current", "join", "enroll", "programs",
    "results", "details", "more info", "more information",
    "league", "division", "divisions", "team", "teams",
    "rules", "pricing", "format", "competition",
    "sport", "sports", "calendar", "scores", "program",
)
NAV_NEGATIVE_WORDS = (
    "aquatic", "swim", "pool", "children", "child", "youth", "junior", "kid", "toddler",
    "preschool", "fitness", "zumba", "yoga", "dance", "pilates", "camp", "daycamp", "day-camp",
)
NAV_SOCIAL_WORDS = ("facebook", "twitter", "instagram", "youtube", "linkedin")
NAV_ACCOUNT_WORDS = ("logout", "login", "signin", "admin", "dashboard", "profile")
RUBRIC_WORDS = {
    100: ("details", "more info", "view league", "league info", "league details",
          "upcoming leagues", "upcoming", "seasons", "all leagues", "programs",
          "register", "registration", "signup", "sign up", "join", "enroll",
          "schedule", "standings", "results", "pricing", "fees", "cost", "prices", "rates",
          "fee"),
    50: ("rules", "format", "teams", "divisions", "division", "competition", "bracket",
         "playoffs", "roster", "scores", "ranking", "leaderboard", "games", "calendar",
         "fixtures", "times", "program", "leagues", "league", "sport", "sports"),
    25: ("about", "news", "facility", "venues", "location", "map"),
    0: ("facebook", "instagram", "twitter", "tiktok", "youtube", "linkedin", "reddit",
        "pinterest", "snapchat",
        "login", "logout", "sign in", "signin", "account", "admin", "dashboard", "profile",
        "checkout", "cart", "my account",
        "privacy", "terms", "legal", "cookie", "cookies", "gdpr", "copyright", "disclaimer",
        "contact", "careers", "jobs", "sitemap", "accessibility"),
}
LISTING_CARD_WORDS = (
    "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday",
    "volleyball", "soccer", "football", "basketball", "softball", "baseball", "hockey",
    "lacrosse", "tennis", "badminton", "pickleball", "dodgeball", "ultimate", "frisbee",
    "flag football", "co-ed", "coed", "men's", "women's", "mixed", "open",
    "indoor", "outdoor", "beach", "grass", "turf", "court",
    "6 v 6", "6v6", "4 v 4", "4v4", "5 v 5", "5v5", "7 v 7", "7v7", "8 v 8", "8v8",
    "spring", "summer", "fall", "autumn", "winter",
)
TAB_WORDS = (
    "standings", "schedule", "teams", "roster", "divisions", "regular season",
    "current season", "season", "league", "fall", "winter", "spring", "summer", "results",
    "games",
)
LINK_TYPE_WORDS = {
    "registration": ("register", "signup", "sign up", "registration", "enroll"),
    "schedule": ("schedule", "games", "game", "times", "fixtures"),
    "standings": ("standings", "results", "scores", "results", "ranking"),
    "league_list": ("leagues", "league info", "divisions", "competition"),
    "rules": ("rules", "format", "regulations", "policy", "policies"),
    "teams": ("teams", "team", "roster"),
}
CATEGORY_OF_LINK_TYPE = {
    "SCHEDULE": ("schedule", "standings", "teams", "results", "scores", "matchups"),
    "REGISTRATION": ("registration",),
    "POLICY": ("rules", "policies", "waiver", "insurance", "referee"),
    "VENUE": ("venue", "location", "facility"),
    "DETAIL": ("league_list", "league", "program", "division", "about", "season"),
}
CATEGORY_OF_LINK_TEXT = {
    "SCHEDULE": ("schedule", "standings", "teams", "results", "scores", "matchups", "upcoming"),
    "REGISTRATION": ("register", "signup", "sign up", "enroll", "payment", "fees", "pricing",
                     "cost"),
    "POLICY": ("rules", "policies", "insurance", "waiver", "referee", "format"),
    "VENUE": ("venue", "location", "facility", "field", "gym", "arena", "court"),
    "DETAIL": ("league", "division", "program", "season", "current", "calendar", "about",
               "sport", "join", "enroll", "upcoming", "more info", "more information"),
}
GENERIC_ANCHORS = (
    "learn more", "learn more!", "click here", "read more", "read more!", "view details",
    "view more", "more info", "more information", "find out more", "find out more!",
    "details", "see more", "apply now", "apply now!", "sign up", "sign up!",
)
TEAM_CELL_PATTERN = (
    r"<(?:td|li|div|span)[^>]*>\s*([A-Z][A-Za-z0-9\s&'.\-]{3,40})\s*</(?:td|li|div|span)>"
)

# --- fixed values: crawl decisions (type, band) -> (collect, follow, defer) ----------------------------
CRAWL_DECISIONS = (
    ("LEAGUE_INDEX", "high", True, True, False),
    ("LEAGUE_INDEX", "medium", True, True, False),
    ("LEAGUE_INDEX", "low", False, False, False),
    ("LEAGUE_DETAIL", "high", True, True, False),
    ("LEAGUE_DETAIL", "medium", True, False, False),
    ("LEAGUE_DETAIL", "low", False, False, False),
    ("SCHEDULE", "high", False, False, True),
    ("SCHEDULE", "medium", False, False, True),
    ("SCHEDULE", "low", False, False, True),
    ("MEDIUM_DETAIL", "high", False, False, True),
    ("MEDIUM_DETAIL", "medium", False, False, True),
    ("MEDIUM_DETAIL", "low", False, False, True),
    ("OTHER", "high", True, True, False),
    ("OTHER", "medium", False, False, False),
    ("OTHER", "low", False, False, False),
)
CRAWL_CHILDREN_PER_PAGE = 30
EXTRA_PAGES_PER_CATEGORY = 3
FIELD_CATEGORIES = ("SCHEDULE", "REGISTRATION", "POLICY", "VENUE", "DETAIL")

# --- fixed values: field groups ----------------------------------------------------------------------------
KEY_FIELDS = (
    "organization_name", "sport_name", "season_year", "venue_name", "day_of_week",
    "source_comp_level", "gender_eligibility", "num_weeks", "players_per_side",
)
EIGHT_KEY_FIELDS = (
    "organization_name", "sport_season_code", "season_year", "venue_name", "day_of_week",
    "source_comp_level", "gender_eligibility", "num_weeks",
)
SIX_KEY_FIELDS = (
    "organization_name", "sport_season_code", "season_year", "venue_name", "day_of_week",
    "source_comp_level",
)
COVERAGE_FIELDS = (
    "day_of_week", "start_time", "venue_name", "team_fee", "individual_fee",
    "season_start_date", "season_end_date", "source_comp_level", "gender_eligibility",
    "num_weeks",
)
ENRICHABLE_FIELDS = (
    "day_of_week", "start_time", "num_weeks", "time_played_per_week", "season_start_date",
    "season_end_date", "stat_holidays", "venue_name", "team_fee", "individual_fee",
    "registration_deadline", "source_comp_level", "gender_eligibility", "players_per_side",
    "slots_left", "has_referee", "requires_insurance", "insurance_policy_link",
)
CATEGORY_OF_FIELD = {
    "num_teams": "SCHEDULE", "day_of_week": "SCHEDULE", "start_time": "SCHEDULE",
    "team_fee": "REGISTRATION", "individual_fee": "REGISTRATION",
    "registration_deadline": "REGISTRATION", "slots_left": "REGISTRATION",
    "has_referee": "POLICY", "requires_insurance": "POLICY", "insurance_policy_link": "POLICY",
    "venue_name": "VENUE",
    "season_start_date": "DETAIL", "season_end_date": "DETAIL", "num_weeks": "DETAIL",
    "time_played_per_week": "DETAIL", "source_comp_level": "DETAIL",
    "gender_eligibility": "DETAIL", "players_per_side": "DETAIL", "stat_holidays": "DETAIL",
}
TIER_ONE_FIELDS = (
    "season_start_date", "season_end_date", "day_of_week", "num_weeks", "venue_name",
    "source_comp_level", "gender_eligibility", "has_referee", "players_per_side",
)
TIER_TWO_FIELDS = ("start_time", "time_played_per_week", "registration_deadline", "num_teams")
COMPARED_FIELDS = (
    "organization_name", "sport_season_code", "season_year", "day_of_week", "start_time",
    "venue_name", "source_comp_level", "gender_eligibility", "team_fee", "individual_fee",
    "num_weeks", "quality_score", "url_scraped", "updated_at",
)

# --- fixed values: statuses, thresholds, enums ----------------------------------------------------------------
QUEUE_STATUSES = ("PENDING", "IN_PROGRESS", "COMPLETED", "FAILED", "SKIPPED")
REPLACE_BELOW, DEEP_BELOW, SUBSTANTIAL_FROM = 60, 75, 90
INSERT_MIN_PCT, INSERT_MIN_PCT_CHILD = 50, 25
VENUE_SAVE_FROM = 60
SPORTS_PLACE_TYPES = (
    "park", "stadium", "sports_complex", "gym", "health", "establishment", "point_of_interest",
)
DUPLICATE_AUTO_FROM, DUPLICATE_REVIEW_FROM = 5, 4
