"""Word lists of the detectors. Callers can pass their own first names; the rest are fixed values."""

# Keywords that announce a value (lower case, as in normalised text).
PHONE_KEYWORDS = ["tel", "tel.", "telefono", "cellulare", "cell", "phone", "mobile", "fax"]
VAT_KEYWORDS = ["p.iva", "p. iva", "partita iva", "piva", "iva", "vat", "vat number", "vat no"]
IBAN_KEYWORDS = ["iban", "coordinate bancarie", "conto corrente", "c/c", "bank account"]
TAX_CODE_KEYWORDS = ["codice fiscale", "cod. fiscale", "cod. fisc.", "c.f.", "c.f", "cf", "tax code", "fiscal code"]
CARD_KEYWORDS = ["carta", "carta di credito", "carta di debito", "bancomat", "card", "credit card", "debit card"]
ID_DOCUMENT_KEYWORDS = [
    "carta d'identità", "carta di identità", "carta d'identita", "documento", "passaporto", "passport", "identity card", "id card", "c.i.", "cie",
]

# Patterns that announce an identifier.
CONTEXT_ID_KEYWORDS = [
    r"patient (?:number|id|no\.?)", r"n\. ?pratica", r"pratica n\.?", "fascicolo", r"case (?:no\.?|number)", r"file (?:no\.?|number)",
    r"contract (?:#|no\.?|number)", r"contratto n\.?", r"n\. ?contratto", "codice contratto", "codice cliente", r"cod\. ?cliente", r"n\. ?cliente",
    "numero cliente", "id cliente", r"customer (?:id|number|no\.?)", r"client (?:id|number|no\.?)", "codice utente", "id utente", "user id",
    "codice utenza", r"n\. ?utenza", "pod", "pdr", "matricola", r"account (?:no\.?|number)", "numero di conto", "codice identificativo",
    r"n\. ?documento", "numero documento", r"document (?:no\.?|number)", r"fattura n\.?", r"n\. ?fattura", "numero fattura",
    r"invoice (?:#|no\.?|number)", r"ordine n\.?", r"n\. ?ordine", "numero ordine", r"order (?:#|no\.?|number)", r"protocollo(?: n\.?)?",
    r"prot\. ?(?:n\.?)?", r"polizza n\.?", r"n\. ?polizza", "numero polizza", r"policy (?:no\.?|number)", r"tessera sanitaria(?: n\.?)?",
    r"tessera n\.?", r"n\. ?tessera", "numero tessera", r"membership (?:no\.?|number)", r"n\. ?iscrizione", r"rif\.", "riferimento", r"ref\.",
    r"reference (?:no\.?|number)", r"istanza n\.?", r"determina(?:zione)? n\.?", r"delibera(?:zione)? n\.?", r"ordinanza n\.?", r"sentenza n\.?",
    r"verbale n\.?", r"gara n\.?", r"appalto n\.?", r"assegno n\.?", r"fideiussione n\.?", r"concessione n\.?", r"autorizzazione n\.?",
    r"licenza n\.?", r"mandato n\.?", r"rep\.(?: n\.?)?", r"repertorio(?: n\.?)?", r"racc\.(?: n\.?)?", r"raccolta n\.?", r"r\.?g\.?(?: n\.?)?",
    r"ruolo generale(?: n\.?)?", "cig", "cup", r"ddt(?: n\.?)?", r"causa n\.?", r"giudizio n\.?", r"reclamo n\.?", r"rapporto n\.?",
    r"patente(?: di guida)?(?: n\.?)?", r"passaporto n\.?", r"documento d\x27identit[aà]\x27? n\.?", r"carta d\x27identit[aà]\x27? n\.?",
]
PLATE_KEYWORDS = [
    "targa", "targato", "targata", r"tg\.", "number plate", "license plate", "licence plate", "registration number", r"registration no\.",
    "plate number", r"plate no\.",
]

# Top-level domains accepted without a scheme or www.
BARE_TLDS = ["it", "com", "org", "net", "eu", "gov", "edu", "info", "biz", "io", "app", "dev", "cloud", "online", "uk", "de", "fr", "ch", "sm"]

# IBAN lengths by country.
IBAN_LENGTHS = {
    "AD": 24, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22,
    "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15,
    "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "VA": 22,
}

# What the characters of a tax code count for at odd places (digits, then A to Z).
TAX_ODD = [1, 0, 5, 7, 9, 13, 15, 17, 19, 21]
TAX_ODD_LETTERS = [1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 2, 4, 18, 20, 11, 3, 6, 8, 12, 14, 16, 10, 22, 25, 24, 23]

# Words of addresses.
STREET_TYPES = [
    "via", "viale", "vialetto", "vicolo", "vicoletto", "vico", "piazza", "piazzale", "piazzetta", "contrada", "località", "frazione", "lungomare",
    "lungotevere", "lungolago", "lungarno", "traversa", "circonvallazione", "scalinata", "borgata",
]
STREET_SHORT = [
    "v.", "v.le", "vle", "p.zza", "p.za", "pza", "p.le", "p.tta", "c.so", "l.go", "lgo", "vic.", "str.", "c.da", "loc.", "fraz.", "trav.", "b.go",
    "sal.", "gall.", "circ.ne",
]
STREET_CAPITALISED = [
    "Corso", "Largo", "Strada", "Stradone", "Stradella", "Borgo", "Salita", "Discesa", "Rampa", "Galleria", "Calle", "Campo", "Fondamenta", "Rione",
    "Passaggio",
]
STREET_SUFFIXES = [
    "Street", r"St\.", "Road", r"Rd\.", "Avenue", r"Ave\.", "Lane", r"Ln\.", "Drive", r"Dr\.", "Boulevard", r"Blvd\.", "Way", "Court", r"Ct\.",
    "Place", "Square",
]
BY_MEANS_OF = [
    "e-?mail", "mail", "pec", "fax", "posta", "sms", "whatsapp", "telegram", "web", "internet", "app", "telefono", "raccomandata", "corriere",
    "bonifico",
]

# Words around names.
FORM_LABELS = [
    "cognome", "nome", "sesso", "cittadinanza", "italiana", "italiano", "stato", "civile", "nato", "nata", "data", "luogo", "nascita", "residenza",
    "residente", "indirizzo", "comune", "provincia", "professione", "codice", "fiscale", "firma", "documento", "rilasciato", "scadenza", "statura",
    "nominativo", "intestatario", "titolare", "sottoscritto", "sottoscritta", "via", "piazza", "name", "surname", "sex", "nationality", "date",
    "birth", "place", "address", "signature", "tel", "email",
]
TITLE = (
    r"(?:sig(?:\.ra|\.na|nora|nor|ra\.?|\.)?|sigg\.?|dott(?:\.ssa|oressa|ore|or|ssa\.?|\.)|dr\.?|avv(?:ocato|ocata|\.)?|ing\.|per\.(?:ind\.)?|"
    r"prof(?:\.ssa|essoressa|essore|essor|\.)?|geom\.|rag\.|arch\.|notaio|mr\.?|mrs\.?|ms\.?|mister|madam)"
)
GREETINGS = [
    "gentile", "gentilissimo", "gentilissima", "egregio", "egregia", "caro", "cara", "carissimo", "carissima", "spettabile", "dear", "hello", "hi",
    "ciao", "buongiorno", "buonasera", "salve", "grazie", "auguri", "complimenti", "bravo", "brava", "thanks",
]
LEGAL_FORMS = [
    "srl", "s.r.l.", "srls", "spa", "s.p.a.", "sas", "s.a.s.", "snc", "s.n.c.", "onlus", "ltd", "ltd.", "llc", "inc", "inc.", "plc", "gmbh", "ag",
    "sa", "corp", "corp.",
]
ORGANIZATION_WORDS = [
    "ufficio", "comune", "società", "societa", "azienda", "studio", "banca", "ditta", "ente", "istituto", "ospedale", "università", "universita",
    "associazione", "fondazione", "cooperativa", "agenzia", "ministero", "regione", "provincia", "servizio", "servizi", "reparto", "direzione",
    "settore", "gruppo", "consorzio", "scuola", "tribunale", "camera", "liceo", "teatro", "stadio", "aeroporto", "chiesa", "basilica", "museo",
    "premio", "parrocchia", "clinica", "company", "office", "department", "bank", "group", "university", "school", "hospital",
]
NAME_LABELS = [
    "nome e cognome", "cognome e nome", "nominativo", "cognome", "nome", "il sottoscritto", "la sottoscritta", "intestatario", "intestataria",
    "titolare", "full name", "surname", "name", "docente", "relatore", "relatrice", "dipendente", "paziente", "cliente", "utente", "richiedente",
    "dichiarante", "beneficiario", "beneficiaria", "delegato", "delegata", "firmatario", "firmataria", "referente", "contraente", "assicurato",
    "assicurata", "proprietario", "proprietaria", "locatore", "locatrice", "conduttore", "conduttrice", "testimone", "tutore",
    "legale rappresentante", "coniuge", "acquirente", "venditore", "venditrice",
]
PLACE_LABELS = [
    "luogo e data di nascita", "luogo di nascita", "comune di nascita", "comune di residenza", "nato a", "nata a", "nato/a a", "residente a",
    "residente in", "place of birth", "born in",
]
PLACE_WORDS = [
    "via", "viale", "piazza", "piazzale", "piazzetta", "corso", "largo", "vicolo", "vico", "contrada", "località", "frazione", "lungomare",
    "lungotevere", "traversa", "salita", "borgo", "strada", "galleria", "calle", "san", "santa", "santo", "sant'", "ponte", "porta", "monte", "villa",
    "palazzo", "castel", "castello", "torre", "isola", "lago", "valle", "capo", "colle", "parco", "stazione",
]
PARTICLES = ["de", "di", "da", "del", "della", "dei", "degli", "dal", "van", "von", "der", "den", "la", "lo", "le", "mc", "mac", "st"]
SURNAME_PARTICLES = ["de", "di", "da", "del", "della", "dello", "dei", "lo", "la", "li", "le"]

# A small sample of common Italian first names; callers pass a full list as a parameter.
FIRST_NAMES = [
    "alessandro", "andrea", "anna", "antonio", "carlo", "caterina", "davide", "elena", "federica", "francesca", "francesco", "giorgia", "giovanni",
    "giulia", "giuseppe", "laura", "lorenzo", "luca", "lucia", "luigi", "marco", "maria", "mario", "matteo", "michele", "paolo", "roberto", "rosaria",
    "sara", "simone", "stefano", "valentina",
]

# Words of organisations.
DOTTED_FORMS = ["s.r.l.s.", "s.r.l.", "s.p.a.", "s.a.s.", "s.n.c.", "s.s.", "s.c.a.r.l.", "s.c.r.l.", "s.c.p.a.", "s.c.", "s.a.p.a.", "l.l.c.", "soc. coop."]
PLAIN_FORMS = [
    "SRLS", "Srls", "SRL", "Srl", "SPA", "SpA", "Spa", "SAS", "Sas", "SNC", "Snc", "SCARL", "Scarl", "ONLUS", "Onlus", "APS", "ETS", "ODV", "Ltd.",
    "Ltd", "LTD", "LLC", "LLP", "Inc.", "Inc", "PLC", "plc", "GmbH", "Corp.", "Corp", "S.A.", "AG",
]
LINKS = ["di", "del", "della", "dello", "dei", "degli", "delle", "e", "per", "of", "and", "for"]
ELIDED_LINKS = ["dell", "d", "all", "sull"]
INSTITUTION_HEADS = [
    "Camera di Commercio", "Casa di Cura", "Città Metropolitana", "Guardia di Finanza", "Comune", "Città", "Provincia", "Regione", "Ministero",
    "Prefettura", "Questura", "Tribunale", "Corte", "Procura", "Agenzia", "Università", "Politecnico", "Ospedale", "Policlinico", "Clinica",
    "Istituto", "Banca", "Fondazione", "Associazione", "Cooperativa", "Consorzio", "Studio", "Azienda", "Liceo", "Scuola", "Parrocchia", "Diocesi",
    "asl", "ausl", "ats", "University", "Ministry", "Bank", "Hospital",
]
GENERIC_BODIES = [
    "consiglio", "amministrazione", "assemblea", "condominiale", "collegio", "sindacale", "comitato", "commissione", "direzione", "generale",
    "segreteria", "presidenza", "board", "committee", "management",
]
NOT_ORGANIZATIONS = [
    "iban", "bic", "swift", "p.iva", "piva", "c.f", "cf", "partita", "codice", "ccnl", "iva", "pec", "cap", "pdf", "iso", "uni", "tfr", "irpef", "isee",
    "spid", "pin", "pod", "pdr", "gdpr", "vat", "eur", "euro", "usd", "gbp", "chf", "m&a", "per", "celibe", "nubile", "coniugato", "coniugata",
    "repubblica", "norma", "decreto", "legge", "regolamento", "direttiva",
]

# Labels of the token classifier that are used, and what they become.
MODEL_LABELS = {
    "FULLNAME": "PERSON", "ORG": "ORGANIZATION", "STREET": "LOCATION", "BUILDINGNUM": "LOCATION", "EMAIL": "EMAIL", "TELEPHONENUM": "PHONE",
    "CREDITCARDNUMBER": "PAYMENT_CARD", "ID_DOC": "ID_DOCUMENT", "DOCID": "CONTEXTUAL_ID", "CATASTO": "CONTEXTUAL_ID",
}
