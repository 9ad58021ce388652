"""Fixed values that results depend on."""

# Hosts whose documents are trusted.
TRUSTED_HOSTS = (
    "hrw.org", "amnesty.org", "ohchr.org", "tribunal.int", "court.int", "un.org", "reliefweb.int", "unhcr.org", "ocha.org", "crisisgroup.org", "prio.org", "ssrn.com",
    "jstor.org", "cambridge.org", "oxfordjournals.org", "archive.org", "acleddata.com", "globalr2p.org", "justicehub.org", "peacepalacelibrary.nl",
)
# Stems that mark a relation of command.
COMMAND_STEMS = (
    "order", "command", "direct", "instruct", "authoris", "authoriz", "sanction", "approve", "mandate", "assign", "dispatch", "deploy", "coordinate", "supervise", "oversee",
    "control", "led", "led the",
)
# Phrases that put a query off topic.
OFF_TOPIC = (
    "patient care", "hospital", "clinical trial", "medication", "drug dosage", "dictionary", "definition of", "synonym", "thesaurus", "vocabulary", "recipe", "cooking", "restaurant",
    "travel", "tourism", "stock market", "cryptocurrency", "investment portfolio", "sports", "football", "basketball", "celebrity",
)
# Words that are no entity.
STOP_WORDS = (
    "the a an and or of in on at to for with by from it its this that these those is are was were be been being have has had do does did will would could should may might shall can not no nor but so yet "
    "document page report source text article unknown"
).split()
# Licence by source.
LICENCES = {"openalex": "open-access", "semanticscholar": "open-access", "arxiv": "open-access", "internetarchive": "open-access", "gdelt": "news"}
# Search templates, by key.
TEMPLATES = {
    "pdf_report": '"{entity}" filetype:pdf human rights report', "hrw_amnesty": '"{entity}" site:hrw.org OR site:amnesty.org OR site:ohchr.org', "icty_icc": '"{entity}" site:tribunal.int OR site:tribunal.int OR site:court.int',
    "un_reliefweb": '"{entity}" site:un.org OR site:reliefweb.int', "tribunal_crime": '"{entity}" war crime genocide slavery tribunal court',
}
DOC_TYPES = ("report", "news", "legal", "grey_literature")
LABELS = ("PERSON", "ORG", "GROUP", "LOCATION", "FACILITY", "EVENT", "LEGAL_INSTRUMENT")
SUFFIXES = ("pdf", "html", "htm", "docx", "txt", "md")
# Hosts that are never visited.
BLOCKED_HOSTS = (
    "dictionary.com", "merriam-webster.com", "collinsdictionary.com", "thesaurus.com", "oxfordlearnersdictionaries.co.uk", "oxforddictionaries.com", "vocabulary.com", "macmillandictionary.com", "cambridge.org/dictionary",
    "en.wiktionary.org", "lexico.com", "reddit.com", "twitter.com", "facebook.com", "instagram.com", "youtube.com", "tiktok.com", "pinterest.com", "amazon.com", "ebay.com", "etsy.com", "tripadvisor.com", "yelp.com", "booking.com",
)
# Search interfaces of the sources, with the place of the quoted entity.
SEARCH_URLS = {
    "openalex": "https://api.openalex.org/works?per-page=25&search={q}", "semanticscholar": "https://api.semanticscholar.org/graph/v1/paper/search?limit=25&fields=title,year,abstract,openAccessPdf&query={q}",
    "arxiv": "http://export.arxiv.org/api/query?max_results=25&search_query=all:{q}", "internetarchive": "https://archive.org/advancedsearch.php?output=json&rows=25&fl[]=identifier,title,date,description&q={q}",
    "gdelt": "https://api.gdeltproject.org/api/v2/doc/doc?mode=artlist&format=json&maxrecords=25&query={q}", "doaj": "https://doaj.org/api/search/articles/{q}?pageSize=25", "europepmc": "https://www.ebi.ac.uk/europepmc/webservices/rest/search?format=json&pageSize=25&query={q}",
    "pubmed": "https://eutils.ncbi.nlm.nih.gov/entrez/eutils/esearch.fcgi?db=pubmed&retmode=json&retmax=25&term={q}", "worldbank": "https://search.worldbank.org/api/v2/wds?format=json&rows=25&qterm={q}", "hdx": "https://data.humdata.org/api/3/action/package_search?rows=25&q={q}",
    "crossref": "https://api.crossref.org/works?rows=25&query={q}", "wikipedia": "https://en.wikipedia.org/w/api.php?action=query&format=json&generator=search&gsrlimit=3&prop=extlinks&ellimit=50&gsrsearch={q}",
}
