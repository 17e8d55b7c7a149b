"""Extraction patterns and column dictionaries.

Fixed values: each pattern and word list below decides which text counts as a
signal, so it must stay as it is for results to agree between engines.
"""

EMAIL = r"(?U)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
PHONE = r"(?U)(?:\+91[\-\s]?)?[6-9]\d{9}\b|\+[1-9]\d{6,14}\b"
NAME_FIELD = (
    r"(?iU)\b(?:name|contact|person|suspect|officer|author|target|subject|holder)"
    r"\s*[:=]\s*([A-Za-z\s.]{2,40})(?=[\r\n,;]|\s{2,}|$)"
)
ORG_FIELD = (
    r"(?iU)\b(?:org|organization|company|agency|firm|bank)"
    r"\s*[:=]\s*([A-Za-z0-9\s.&]{2,50})(?=[\r\n,;]|\s{2,}|$)"
)
IFSC = r"(?U)\b[A-Z]{4}0[A-Z0-9]{6}\b"
ACCOUNT_FIELD = (
    r"(?iU)\b(?:a/c|acc|account|bank\s*a/c)\s*(?:no\.?|num(?:ber)?\.?)?\s*[:=]?\s*([0-9]{9,18})\b"
)
LOOSE_PHONE = r"(?:\+?\d{1,3}[\-\s]?)?\(?\d{3}\)?[\-\s]?\d{3}[\-\s]?\d{4}|\+?[6-9]\d{9,11}"
LOOSE_EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
DIGIT_RUN = r"\+?[1-9]\d{1,14}"

HEADER_SPLIT = r'[,;](?=(?:[^"]*"[^"]*")*[^"]*$)'
HEADER_NAMED = r"""^(?:"|')?([^<>"]+?)(?:"|')?\s*<([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})>$"""

PHONE_COLUMNS = [
    "phone", "mobile", "contact_no", "contact_number", "phone_number", "tel", "sender_phone", "receiver_phone",
]
EMAIL_COLUMNS = ["email", "mail", "email_address", "sender_email", "receiver_email"]
NAME_COLUMNS = [
    "name", "full_name", "contact_name", "person_name", "suspect_name", "target_name", "sender_name",
    "receiver_name", "user_name",
]
ACCOUNT_COLUMNS = ["account_no", "account_number", "acc_no", "ifsc", "upi_id", "bank_account"]
LOCATION_COLUMNS = ["location", "city", "address", "state", "gps_coords"]

SYSTEM_USERS = ["SYSTEM", "LOCAL SERVICE", "NETWORK SERVICE", "ROOT", "DEFAULT", "ALL USERS"]
