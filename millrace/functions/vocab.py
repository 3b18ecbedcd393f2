"""Word lists, constants and patterns of the posting rules.

Fixed values: results depend on them, so they are stated as they are.
"""

# --- links -----------------------------------------------------------------------------------------------------------
TRACKING_PARAMS = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "utm_source_platform", "utm_creative_format",
    "ref", "refid", "referrer", "source", "src", "gh_src", "gh_jid_src", "trackingid", "trk", "trkinfo", "originaltrackingid",
    "lipi", "licu", "position", "pagenum", "fbclid", "gclid", "msclkid", "sessionid", "sid", "cid", "mc_cid", "mc_eid",
    "from", "campaignid", "jobid_src",
]
BLOCKED_BOARDS = ["vacancyglobalpro", "vacancyjobspro", "remotezestjobs", "zestjobs", "remoteclickjobs"]
FREE_HOSTS = ["railway.app", "onrender.com", "render.com", "vercel.app", "netlify.app", "fly.dev", "pages.dev", "glitch.me", "replit.app", "repl.co", "herokuapp.com"]
FUNNEL_HOSTS = ["victorytuitions.in"]
JOB_PATH = r"/(job|jobs|apply|career|vacan|position|opening|hiring)"
SITE_NAMES = [
    (["linkedin.com"], "LinkedIn"), (["indeed.com"], "Indeed"), (["glassdoor.com"], "Glassdoor"), (["ziprecruiter.com"], "ZipRecruiter"),
    (["remoteok"], "RemoteOK"), (["weworkremotely.com"], "We Work Remotely"), (["flexjobs.com"], "FlexJobs"), (["monster.com"], "Monster"),
    (["careerbuilder.com"], "CareerBuilder"), (["simplyhired.com"], "SimplyHired"), (["dice.com"], "Dice"), (["greenhouse.io"], "Greenhouse"),
    (["lever.co"], "Lever"), (["workday.com"], "Workday"), (["smartrecruiters.com"], "SmartRecruiters"), (["jobvite.com"], "Jobvite"),
    (["icims.com"], "iCIMS"), (["taleo.net"], "Taleo"), (["hired.com"], "Hired"), (["angel.co", "wellfound.com"], "Wellfound"),
    (["builtin.com"], "Built In"), (["themuse.com"], "The Muse"), (["stackoverflow.com", "jobs.stackoverflow"], "Stack Overflow"),
    (["ycombinator.com"], "Y Combinator"),
]

# --- titles and companies -----------------------------------------------------------------------------------------------
TITLE_NOISE = [
    r"\((?:[^()]*)\)", r"\[[^\[\]]*\]", r"\bm\s*/\s*[wf]\s*/\s*[dx]\b", r"\b[wf]\s*/\s*m\s*/\s*[dx]\b", r"\bm\s*/\s*[wf]\b",
    r"\b(?:fully\s+)?remote\b", r"\bhybrid\b", r"\bon[\s-]?site\b", r"\bfull[\s-]?time\b", r"\bpart[\s-]?time\b", r"\bcontract\b",
    r"\bpermanent\b", r"\bfreelance\b", r"\bintern(?:ship)?\b", r"\burgent(?:ly)?\s+hiring\b", r"\bnew\b\s*$", r"\bh/f\b", r"\bw/m/d\b",
]
COMPANY_SUFFIXES = [
    "incorporated", "inc", "llc", "l.l.c", "ltd", "limited", "plc", "corporation", "corp", "company", "co", "gmbh", "mbh", "ag", "kg",
    "gmbh & co kg", "b.v", "bv", "n.v", "nv", "s.a", "sa", "s.a.s", "sas", "s.r.l", "srl", "s.p.a", "spa", "a/s", "as", "ab", "oy", "aps",
    "d.o.o", "doo", "a.d", "ad", "pty", "pty ltd", "sp z o.o", "sp zoo", "z o.o", "group", "holding", "holdings", "international",
]

# --- rejection ----------------------------------------------------------------------------------------------------------
DEALBREAKERS = [
    "security clearance", "clearance required", "top secret", "secret clearance", "ts/sci", "must be a us citizen", "us citizenship required",
    "active clearance", "government clearance", "15+ years", "15 years of experience", "20+ years", "20 years of experience", "no remote",
    "not a remote", "on-site only", "onsite only", "must be onsite", "relocation required", "must relocate",
]
DEV_TITLES = [
    "software engineer", "software developer", "sw engineer", "backend engineer", "back-end engineer", "backend developer",
    "frontend engineer", "front-end engineer", "frontend developer", "full stack", "full-stack", "fullstack", "web developer",
    "devops engineer", "site reliability", "sre engineer", "platform engineer", "java developer", "python developer", ".net developer",
    "c++ developer", "c# developer", "golang developer", "go developer", "rust developer", "php developer", "ruby developer",
    "node developer", "node.js developer", "ios developer", "android developer", "mobile developer", "embedded software", "firmware engineer",
]
DEV_KEEP_SCORE = 20.0
SPONSOR = [
    "visa sponsorship", "sponsor a visa", "sponsor your visa", "we sponsor", "will sponsor", "happy to sponsor", "happily sponsor",
    "glad to sponsor", "we can sponsor", "we do sponsor", "sponsor visas", "sponsoring visas", "sponsor a work visa", "sponsor work visas",
    "sponsorship available", "offer sponsorship", "provide sponsorship", "sponsorship provided", "work visa sponsorship",
    "work permit sponsorship", "visa support", "relocation support", "relocation assistance", "relocation package", "we relocate",
    "open to international", "international applicants welcome", "hire internationally", "visa sponsorship available",
]
NO_SPONSOR = [
    "no visa sponsorship", "no sponsorship available", "not offer sponsorship", "do not offer sponsorship", "do not provide sponsorship",
    "cannot sponsor", "unable to sponsor", "unable to provide sponsorship", "without sponsorship", "not able to sponsor",
    "sponsorship is not available", "we do not sponsor", "no relocation",
]
PERMIT_NEEDED = [
    "must be authorized to work in", "must be authorised to work in", "must have the right to work in", "must be eligible to work in",
    "must be legally authorized to work", "must be legally authorised to work", "work authorization required", "work authorisation required",
    "must hold a valid work permit", "valid work permit required", "must have existing work authorization", "must be a citizen",
    "must be a permanent resident", "us residents only", "united states only", "us only", "us-based candidates only",
    "us based candidates only", "us citizens only", "green card", "eu citizens only", "eu nationals only", "uk residents only",
    "right to work in the uk", "canada only", "canadian residents only", "australia only",
]
WORLDWIDE = [
    "worldwide", "global", "anywhere in the world", "work from anywhere", "open to candidates worldwide", "remote worldwide",
    "fully remote worldwide", "international candidates", "no visa required", "no work permit required", "no sponsorship required",
    "bosnia", "serbia", "balkans",
]
SCAM_PHRASES = [
    "via whatsapp", "on whatsapp", "whatsapp:", "contact me on whatsapp", "reach me on whatsapp", "via telegram", "telegram to apply",
    "apply on telegram", "message me on telegram", "dm me on telegram", "text us to apply", "text to apply", "text me to apply", "sms to apply",
    "registration fee", "processing fee", "application fee", "startup fee", "onboarding fee", "pay a fee to", "refundable deposit",
    "security deposit required", "reshipping", "package forwarding", "money mule", "payment processing agent from home",
]
NON_ENGLISH_TITLES = ["entwickler", "ingenieur", "leiter", "kaufmann", "kauffrau", "vertrieb", "werkstudent", "praktikant", "ausbildung", "mitarbeiter", "sachbearbeiter", "buchhalter"]
REMOTE_WORDS = ["remote", "work from home", "wfh", "virtual", "distributed", "telecommute", "home-based"]
REMOTE_WORDS_SHORT = ["remote", "work from home", "wfh", "virtual", "distributed"]
US_NAMES = ["united states", "usa", "u.s.a", "u.s."]
US_STATES = [
    "AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DE", "FL", "GA", "HI", "ID", "IL", "IN", "IA", "KS", "KY", "LA", "ME", "MD", "MA", "MI", "MN",
    "MS", "MO", "MT", "NE", "NV", "NH", "NJ", "NM", "NY", "NC", "ND", "OH", "OK", "OR", "PA", "RI", "SC", "SD", "TN", "TX", "UT", "VT", "VA",
    "WA", "WV", "WI", "WY", "DC",
]
EXPIRED_PHRASES = [
    "no longer available", "job is no longer", "position has been filled", "this job has expired", "listing has expired",
    "job has been filled", "job has closed", "this position is closed", "posting has been removed", "job is closed", "no longer accepting",
    "position is no longer", "this job is closed", "application closed", "vacancy closed", "role has been filled", "position filled",
    "job removed", "sorry, this job", "this job posting has been removed",
]
EXPIRED_MARKERS = [
    "no longer accepting applications", "no longer available", "this job has expired", "job posting has expired", "posting has expired",
    "position has been filled", "this position is no longer", "posting is no longer active", "job is no longer available",
    "this job is no longer", "nicht mehr verfügbar",
]

# --- scores -------------------------------------------------------------------------------------------------------------
TITLE_BOOST = [
    "sales engineer", "technical sales", "pre-sales", "presales", "application engineer", "solutions engineer", "technical account",
    "mechanical engineer", "process engineer", "cfd engineer", "content strategist", "technical writer", "seo specialist", "ai engineer",
    "automation engineer", "systems engineer", "field engineer", "product engineer", "appointment setter", "sales development", "sdr", "bdr",
    "sales representative", "business development representative", "outbound sales", "lead generation", "inside sales",
]
SECTOR_BOOST = [
    "industrial", "manufacturing", "valve", "fluid", "hydraulic", "pneumatic", "automation", "process industry", "oil and gas", "oil & gas",
    "mining", "energy", "utilities", "pipeline", "instrumentation", "sensors", "mechanical", "engineering components", "distribution", "mro",
    "saas", "b2b software", "enterprise software", "platform", "developer tools", "devops", "cloud", "infrastructure", "iot", "industry 4.0",
    "field service", "asset management", "cmms", "erp", "plm", "scada", "technical marketing", "product marketing", "developer marketing",
    "content operations", "demand generation",
]
TITLE_FACTOR, SECTOR_FACTOR = 1.4, 1.3
US_FACTOR, ON_SITE_FACTOR, SCAM_FACTOR = 0.6, 0.85, 0.35
SKILLS_COUNTED = 15
SAVED_SOURCES = ["Gmail Draft"]

# --- digests ------------------------------------------------------------------------------------------------------------
DIGEST_SIZE, BOARD_SLOTS, AGGREGATOR_SLOTS, COMPANY_CAP, DIRECT_SIZE, DIGEST_SCORE = 15, 5, 5, 2, 10, 10
BOARD_SOURCES = ["Greenhouse", "Lever", "Ashby", "SmartRecruiters", "Workday", "SuccessFactors"]
DEMOTED_SOURCES = ["indeed", "jsearch"]

# --- reports ------------------------------------------------------------------------------------------------------------
INDUSTRIES = [
    ("Engineering", ["engineer", "mechanical", "systems", "process", "cfd", "solidworks", "autocad", "technical engineer", "aerospace", "structural"]),
    ("AI & Automation", ["ai", "artificial intelligence", "machine learning", "automation", "nlp", "deep learning", "llm", "ml engineer", "ai integration"]),
    ("Content & Strategy", ["content", "strategist", "copywriter", "technical writer", "documentation", "seo", "content marketing", "blog", "editorial"]),
    ("Sales Engineering", ["sales engineer", "pre-sales", "solutions engineer", "technical sales", "account engineer", "value engineer"]),
    ("Oil & Gas", ["oil", "gas", "petroleum", "upstream", "downstream", "refinery", "pipeline", "energy", "oilfield"]),
    ("Project Management", ["project manager", "program manager", "scrum", "agile", "delivery manager", "pmo"]),
    ("Architecture", ["solutions architect", "cloud architect", "enterprise architect", "system architect"]),
    ("Software Development", ["software developer", "backend", "frontend", "fullstack", "python developer", "javascript", "devops"]),
    ("Data & Analytics", ["data engineer", "data scientist", "analytics", "business intelligence", "sql", "data analyst"]),
]

# --- mail ---------------------------------------------------------------------------------------------------------------
REJECTED_SUBJECTS = ["unsuccessful", "not selected", "not moving forward", "decided not to progress", "regret to inform", "sorry to inform", "will not be moving", "not be considered"]
REJECTED_BODIES = [
    "decided not to move forward", "decided not to progress", "moving forward with other", "move forward with other candidates",
    "not be moving forward", "unsuccessful", "not shortlisted", "not been selected", "unable to offer", "not meet our requirements",
    "did not meet", "sorry to inform you", "regret to inform", "will not be considered", "not selected for", "results did not", "not proceed",
    "not progress", "chosen not to proceed",
]
APPLICATION_WORDS = ["applied", "application", "submitted", "sent to", "confirmation", "thank you for applying", "your application has been", "we have received your application", "application landed", "received your application"]
DROPPED_SENDERS = ["jobalerts-noreply@linkedin", "glassdoor", "updates.coursiv", "community", "newsletter@", "digest@", "news@", "temu@", "orders.temu", "rabbitresume", "talent-feedback"]
DROPPED_SUBJECTS = [
    "is hiring", "job alert", "don't miss", "don’t miss", "complete your application", "reminder", "incomplete", "privacy notice",
    "data privacy", "almost there", "we are hiring", "new jobs", "jobs for you", "recommended for you", "viewed by", "don't forget",
    "don’t forget", "vip", "unfinished", "provide feedback", "order confirmation", "discount", "boost your job", "next step in your application",
]
SUBJECT_PATTERNS = [
    (r"you applied to (.+?) at (.+)", "tc"), (r"your application(?:s)? for (.+?) at (.+)", "tc"),
    (r"application submitted[:\-–]?\s*(.+?) at (.+)", "tc"), (r"application submitted\s*[-–]\s*(.+?)\s+on\s+(.+)", "tc"),
    (r"application confirmation[:\-–]+\s*(.+?)[–\-]+\s*(.+)", "tc"), (r"(.+?)\s*[–\-]+\s*application submitted", "t"),
    (r"^(.+?)\s+application confirmation for\s+(.+)", "ct"), (r"thank you for applying to (.+?)\s*[-–—]\s*(.+?)[​‌‍﻿\s]*$", "ct"),
    (r"thank you for applying to (.+?)(?:,\s*\w+)?$", "c"), (r"application received[!.:\s]+(.+)", "t"),
    (r"(.+?)\s*[-–]\s*confirmation of your application", "t"), (r"your application was sent to (.+)", "c"),
    (r"application sent to (.+)", "c"), (r"(?:action needed[:\s]+)?your application for (.+)", "t"),
]
BODY_TITLES = [
    r"apply(?:ing)? for the position (.+?)(?:[.,]| we | you |$)", r"submitting your application for (?:the )?(.+?) (?:position|role|internship)",
    r"your application for (?:the )?(.+?) (?:position|role)", r"applying for (?:the )?(.+?) (?:position|role)",
    r"apply for the (.+?) (?:job position|position|role)", r"application for (?:the )?(.+?) (?:position|role)",
    r"interest in (?:our |the |your )?(.+?) (?:position|role)", r"application to (?:\d+\s+)?(.+?) (?:and your interest|and your|\. )",
    r"for the (.+?) (?:job )?position", r"review your application for (.+?)(?: shortly| soon|[.,])",
]
BODY_COMPANIES = [
    r"joining ([A-Z][A-Za-z0-9&.'\- ]{1,38}?)(?:[.,!]| shortly| team|\?|$)", r"(?:position|role) at ([A-Z][A-Za-z0-9&.'\- ]{1,38}?)(?:[.,!]|\?|$)",
    r"interest in (?:joining )?([A-Z][A-Za-z0-9&.'\- ]{1,38}?)[.,!?]",
]
COMPANY_JUNK = ["privacy", "notice", "newsletter", "community", "no-reply", "noreply", "do not reply", "donotreply", "dayforce", "list-style", "margin", "font-family", "padding", "ck_content", "outlook", "table.body", "px", ";", "{", "}", "externalclass", "viewport", "http"]
AGGREGATORS = ["linkedin", "indeed", "jooble", "glassdoor", "ziprecruiter", "monster", "simplyhired"]
BAD_FIRST_WORDS = [
    "for", "to", "at", "was", "and", "in", "on", "with", "of", "the", "a", "an", "your", "our", "this", "that", "is", "are", "has", "have", "we",
    "you", "us", "it", "confirmation", "follow", "review", "application", "landed", "update", "thank", "received", "submitted", "no-reply", "no",
]
STOP_TITLES = ["this", "the", "a", "an", "our", "your", "that", "it", "them", "you", "us", "future positions", "this position", "the position", "this role", "the role", "these", "any", "position (unknown)"]

# --- searches -----------------------------------------------------------------------------------------------------------
# Which tier of queries each source gets, and how many of them (None: all).
SOURCE_QUERIES = [
    ("JSearch", "specific", None), ("Free aggregators", None, None), ("LinkedIn", "specific", 5), ("SerpAPI", "specific", 5), ("Apify", "specific", 3),
    ("DuckDuckGo", "broad", 10),
]

# --- application mails: parts that no title or company has, senders, hosts of boards -----------------------------------------
BAD_PARTS = [
    "http", "href=", "<a ", "</", "&nbsp", "@media", "font-", "<!--", "px;", "color:", "margin", "padding", ".com/", "www.", "no. 07",
    "&amp", "style=",
]
PROSE = [
    "your", "our", "you are", "thank", "time", "needs", "department", "selected", "interest", "national", "waitlisted", "capture", "spent", "reviewing",
    "feedback", "difference", "recruiting", "regarding", "applying", "applied", "application", "submitted", "received", "reviewed", "decided", "pursue",
    "marine storekeeper", "recruitment team", "talent team", "hiring team",
]
TEAM_NAMES = [
    "Workday Notifications", "TalentHub", "Talent Acquisition", "Applications Team", "Hiring Team", "Recruitment Team", "Recruiting",
    "Recruiter", "Alerts", "Notifications", "HR", "Careers", "Jobs",
]
TENANT_HOSTS = [
    "myworkday.com", "recruitee.com", "ashbyhq.com", "greenhouse.io", "lever.co", "smartrecruiters.com", "jobvite.com", "icims.com",
    "taleo.net", "csod.com", "manatal.com", "applytojob.com", "pinpoint.email", "allibo.com",
]
SUBDOMAIN_HOSTS = ["talentadore.com", "talentlyft.com", "teamtailor-mail.com", "teamtailor.com", "talent-tailor.com"]
BOARD_HOSTS = [("jobot.com", "Jobot"), ("mercor.com", "Mercor"), ("micro1.ai", "micro1"), ("tally.so", None)]
GENERIC_LABELS = ["mail", "jobs", "noreply", "alerts", "talentadore", "talentlyft"]

STYLE_RULES = [
    r"(?i)@(?:media|import|font-face|-ms-viewport|viewport|charset)[^{;]*\{[^}]*\}", r"(?i)@import[^;]*;", r"[.#][\w.\- ]+\s*\{[^}]*\}", r"[\w.\-]+\s*\{[^}]*\}",
    r"\{[^}]*\}", r"https?://\S+",
]

# Where a page's description stands, the first that fits wins; elements that never belong to it; hosts whose pages need a login.
PAGE_SELECTORS = [
    ".posting-body", ".job__description", "#content .section", ".ashby-job-posting-description", '[data-ui="job-description"]', ".job-description", ".description",
    '[class*="jobDescription"]', '[class*="job-detail"]', '[class*="posting-body"]', "main article", "main", "article",
]
PAGE_NOISE = ["script", "style", "nav", "footer", "header", "noscript"]
UNREADABLE_HOSTS = ["myworkday.com", "workday.com", "linkedin.com", "taleo.net", "csod.com", "icims.com"]

# Networks that are not public (true), and public ones within them (false); the longest prefix counts.
NETWORKS = {
    "0.0.0.0/8": True, "10.0.0.0/8": True, "127.0.0.0/8": True, "169.254.0.0/16": True, "172.16.0.0/12": True, "192.0.0.0/24": True, "192.0.0.9/32": False, "192.0.0.10/32": False,
    "192.0.2.0/24": True, "192.168.0.0/16": True, "198.18.0.0/15": True, "198.51.100.0/24": True, "203.0.113.0/24": True, "224.0.0.0/4": True, "240.0.0.0/4": True,
    "::ffff:0:0/96": False, "::/8": True, "100::/8": True, "200::/7": True, "400::/6": True, "800::/5": True, "1000::/4": True, "4000::/3": True, "6000::/3": True, "8000::/3": True,
    "a000::/3": True, "c000::/3": True, "e000::/4": True, "f000::/5": True, "f800::/6": True, "fe00::/9": True, "2001::/23": True, "2001:1::1/128": False, "2001:1::2/128": False,
    "2001:3::/32": False, "2001:4:112::/48": False, "2001:20::/28": False, "2001:30::/28": False, "2001:db8::/32": True, "2002::/16": True, "3fff::/20": True, "fc00::/7": True,
    "fe80::/10": True, "ff00::/8": True,
}
