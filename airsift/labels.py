"""Fixed texts and limits. They equal those of existing reports, so that results
can be compared value by value; change them only together with the consumers."""

from __future__ import annotations

# --- fixed values: vendor and subtype dimensions ---------------------------
OUI_VENDORS = [
    ("00:1A:79", "Cisco"),
    ("00:1B:63", "Apple"),
    ("00:1C:B3", "Apple"),
    ("00:1D:4F", "Apple"),
    ("00:1E:C2", "Apple"),
    ("00:1F:5B", "Apple"),
    ("00:21:E9", "Apple"),
    ("00:22:41", "Apple"),
    ("00:23:12", "Apple"),
    ("00:23:32", "Apple"),
    ("00:23:6C", "Apple"),
    ("00:25:00", "Apple"),
    ("00:25:4B", "Apple"),
    ("00:26:08", "Apple"),
    ("00:26:BB", "Apple"),
    ("3C:A7:AE", "Technicolor"),
]
VENDOR_UNKNOWN = "Bilinmiyor"
VENDOR_RANDOMIZED = "Private / Randomized MAC"

SUBTYPE_NAMES = [
    ("0", "Association Request"),
    ("1", "Association Response"),
    ("2", "Reassociation Request"),
    ("3", "Reassociation Response"),
    ("4", "Probe Request"),
    ("5", "Probe Response"),
    ("8", "Beacon"),
    ("10", "Disassociation"),
    ("11", "Authentication"),
    ("12", "Deauthentication"),
]
SUBTYPE_PREFIX = "Subtype "

# --- fixed values: addresses that are never clients ------------------------
BROADCAST_MAC = "ff:ff:ff:ff:ff:ff"
MULTICAST_PREFIXES = ["01:00:5e", "33:33"]

# --- fixed values: placeholders --------------------------------------------
HIDDEN_SSID = "<gizli veya belirtilmemiş SSID>"
SSID_FALLBACK = {
    "table": "<Gizli SSID>",
    "report": "SSID belirlenemedi",
    "cli": "<SSID belirlenemedi veya gizli>",
}
VALUE_FALLBACK = {"table": "—", "report": "Bilinmiyor", "cli": "bilinmiyor"}
NO_VALUE = "—"

# --- fixed values: activity, handshake and signal limits -------------------
ACTIVITY_HIGH, ACTIVITY_MEDIUM, ACTIVITY_LOW = "Yüksek", "Orta", "Düşük"
ACTIVITY_HIGH_FROM = 1000
ACTIVITY_MEDIUM_FROM = 250
HANDSHAKE_STRONG, HANDSHAKE_PARTIAL = "strong_candidate", "partial"
HANDSHAKE_STRONG_FROM = 4
HANDSHAKE_STATUS_TEXT = {HANDSHAKE_STRONG: "Güçlü Aday", HANDSHAKE_PARTIAL: "Kısmi"}
VERDICT_STRONG = "● Güçlü Aday (%d)"
VERDICT_PARTIAL = "● Kısmi (%d)"
VERDICT_NONE = "● Bulunamadı"
WEAK_SIGNAL_DBM = -80
BUSY_CLIENT_FROM = 10000

# --- fixed values: finding labels and texts --------------------------------
SEVERITY_LABELS = [
    ("critical", "KRİTİK"),
    ("warning", "UYARI"),
    ("info", "BİLGİ"),
    ("success", "BAŞARILI"),
]
SEVERITY_DEFAULT_LABEL = "BİLGİ"
CATEGORY_DEFAULT = "general"
NO_FINDINGS_TEXT = "Analiz sonucunda ek bir güvenlik bulgusu üretilmedi."

FINDING_STRONG = (
    "success",
    "handshake",
    "Handshake adayı tespit edildi",
    "%d istemci/ağ eşleşmesinde en az 4 EAPOL paketi gözlemlendi.",
)
FINDING_PARTIAL = (
    "warning",
    "handshake",
    "Kısmi EAPOL alışverişi",
    "%d istemci/ağ eşleşmesinde tamamlanmamış EAPOL trafiği gözlemlendi.",
)
FINDING_NO_HANDSHAKE = (
    "info",
    "handshake",
    "Handshake gözlemlenmedi",
    "Yakalama dosyasında istemci/ağ bazında yeterli EAPOL trafiği tespit edilmedi.",
)
FINDING_RANDOMIZED = (
    "info",
    "privacy",
    "Randomized MAC kullanımı",
    "%d istemcide locally administered / randomized MAC adresi gözlemlendi.",
)
FINDING_NO_SSID = (
    "info",
    "wireless",
    "SSID bilgisi belirlenemedi",
    "%d ağ için yakalama verisinden SSID bilgisi belirlenemedi.",
)
FINDING_WEAK = (
    "warning",
    "signal",
    "Zayıf sinyal gözlemlendi",
    "%d ağda -80 dBm veya daha düşük ortalama sinyal seviyesi gözlemlendi.",
)
FINDING_BUSY = (
    "info",
    "activity",
    "Yüksek istemci aktivitesi",
    "%d istemci {busy_from} veya daha fazla paket ile yüksek trafik aktivitesi gösterdi. "
    "En yoğun istemci: %s (%d paket).",
)
FINDING_UNKNOWN_VENDOR = (
    "info",
    "device",
    "Üreticisi belirlenemeyen cihazlar",
    "%d istemcinin üreticisi mevcut offline OUI veritabanından belirlenemedi.",
)

# --- fixed values: notes under a network's client list ---------------------
NO_CLIENTS_NOTE = "Bu ağ için istemci gözlemlenmedi."
MORE_CLIENTS_NOTE = (
    "Not: Bu ağda toplam %d istemci gözlemlendi; raporda paket aktivitesine göre "
    "ilk 25 istemci gösteriliyor."
)

# --- fixed values: JSON envelope --------------------------------------------
ENVELOPE_MODULE = "Wi-Fi Forensics"

# --- fixed values: CSV headers ----------------------------------------------
NETWORKS_CSV_COLUMNS = ["SSID", "BSSID", "Kanal", "Ortalama_Sinyal_dBm", "Istemci_Sayisi"]
CLIENTS_CSV_COLUMNS = ["BSSID", "SSID", "Istemci_MAC", "Paket_Sayisi"]

# --- fixed values: list lengths ----------------------------------------------
TOP_TALKERS = 20
CLI_TOP_SOURCES = 10
CLI_CLIENTS = 10
CLI_EAPOL = 50
REPORT_CLIENTS = 25
CHART_ROWS = 10
