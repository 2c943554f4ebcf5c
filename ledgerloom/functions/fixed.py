"""Words, patterns, weights and thresholds that results depend on."""

# Months by name.
MONTHS = {
    "ocak": 1, "şubat": 2, "subat": 2, "mart": 3, "nisan": 4, "mayıs": 5, "mayis": 5, "haziran": 6, "temmuz": 7, "ağustos": 8,
    "agustos": 8, "eylül": 9, "eylul": 9, "ekim": 10, "kasım": 11, "kasim": 11, "aralık": 12, "aralik": 12,
}

# Currency signs and local names; ISO codes stand for themselves.
CURRENCY_SIGNS = {
    "₺": "TRY", "TL": "TRY", "$": "USD", "US$": "USD", "€": "EUR", "£": "GBP", "¥": "JPY", "₽": "RUB", "₩": "KRW", "₹": "INR", "₴": "UAH",
    "₦": "NGN", "₫": "VND", "₪": "ILS", "₱": "PHP", "฿": "THB", "₡": "CRC", "₲": "PYG", "₸": "KZT", "د.إ": "AED", "ر.س": "SAR",
}

# Date, amount and installment patterns.
DAY_FIRST = r"\d{1,2}[./-]\d{1,2}[./-]\d{2,4}"
YEAR_FIRST = r"\d{4}[./-]\d{1,2}[./-]\d{1,2}"
AMOUNT = r"[-+]?\d{1,3}(?:[.,]\d{3})*(?:[.,]\d{2})|[-+]?\d+(?:[.,]\d{2})"
PLAIN_AMOUNT = r"\d{1,3}(?:[.,]\d{3})*(?:[.,]\d{2})|\d+(?:[.,]\d{2})"
INSTALLMENT_CURRENT = r"(?i)(\d{1,2})\s*\.?\s*Taksit"
INSTALLMENT_FRACTION = r"\((\d{1,2})\s*/\s*(\d{1,2})\)"

# Words that mark a line as no transaction, and as a credit.
NOISE_WORDS = [
    "müşteri limiti", "musteri limiti", "kart limiti", "nakit avans limiti", "dönem borcunuz", "donem borcunuz", "min. ödeme", "min. odeme",
    "asgari ödeme", "asgari odeme", "toplam bonus", "harcanabilecek", "hesap özeti", "hesap ozeti", "son ödeme", "son odeme", "ekstre no",
    "ekstre sayfası", "mersis numarası", "büyük mükellefler", "garanti bankası", "müşteri numarası", "musteri numarası", "kart numarası",
    "kart numarasi",
]
CREDIT_WORDS = ["iade", "ödemeniz için teşekkür", "odemeniz icin tesekkur", "teşekkür ederiz", "tesekkur ederiz", "alacak", "refund", "cashback", "ödeme", "odeme"]
ARTIFACTS = ["bosluk", "BOŞLUK", "□"]
EDGE = " -–—|:,;"

# Merchants known by a part of their name, first match wins.
MERCHANT_ALIASES = {
    "OBILET": "OBILET.COM", "OBİLET": "OBILET.COM", "IYZICO AMAZON": "IYZICO *AMAZON.COM", "IYZICO *AMAZON": "IYZICO *AMAZON.COM",
    "BKMKITAP": "IYZICO/BKMKITAP.COM", "PEGASUS": "PEGASUS", "MEDIA MARKT": "MEDIA MARKT", "TRENDYOL": "TRENDYOL", "STEAM": "STEAM",
}

# Words of a merchant text that say nothing about it.
MERCHANT_NOISE = ["pos", "harcama", "i̇şyeri", "isyeri", "işyeri", "ref", "referans", "terminal", "tutar", "tl", "try", "kart", "provizyon", "onay", "taksit"]

# The taxonomy in its order: category, label, subcategory, patterns (each between word bounds).
TAXONOMY = [
    ("travel", "Seyahat", "flight_transport", ["pegasus", "thy", "turkish airlines", "wizz", "sunexpress", "ajet", "obilet", "enuygun", "flight", "airlines?"]),
    ("food", "Yeme İçme", "delivery_restaurant", ["trendyol yemek", "yemeksepeti", "getir yemek", "migros yemek", "starbucks", "mcdonald'?s", "burger king", "domino'?s", "kfc", "popeyes", "restaurant", "restoran", "cafe", "kafe", "pastane"]),
    ("groceries", "Market", "supermarket", ["migros", "bim", "a101", "sok market", "şok market", "carrefour", "macrocenter", "file market", "hakmar", "market", "getir", "banabi", "marketpaketi"]),
    ("fuel", "Akaryakıt", "gas_station", ["shell", "bp", "opet", "petrol ofisi", r"po\s?petrol", "total", "aytemiz", "lukoil", "moil", "akaryak", "benzin", "petrol"]),
    ("transport", "Ulaşım", "ride_hailing_transit", ["uber", "bitaksi", "martı", "marti", "scooter", "iett", "istanbulkart", "metro istanbul", "hgs", "ogs", "otopark", "ispark", "taksi"]),
    ("health", "Sağlık", "pharmacy_medical", ["eczane", "hastane", "acıbadem", "acibadem", "medical park", "memorial", "medikal", "klinik", "laboratuvar", "poliklinik", "saglik", "sağlık"]),
    ("clothing", "Giyim", "apparel", ["lc waikiki", "lcw", "zara", "h&m", "koton", "defacto", "mavi", "boyner", "pull&bear", "bershka", "stradivarius", "decathlon"]),
    ("entertainment", "Eğlence", "gaming_digital", ["playstation", "steam", "netflix", "spotify", "blutv", "exxen", "gain", "disney", "youtube", "sinema", "cinemaximum"]),
    ("telecom", "İletişim", "mobile_internet", ["turkcell", "vodafone", "turk telekom", "türk telekom", "turknet", "superonline", "millenicom", "ttnet"]),
    ("subscription", "Abonelik", "digital_subscription", ["icloud", "google one", r"google\s?storage", "microsoft", "office 365", "adobe", "amazon prime", "prime video", "linkedin", "chatgpt", "openai"]),
    ("shopping", "Alışveriş", "electronics", ["media markt", "mediamarkt", "teknosa", "vatan bilgisayar", "apple"]),
    ("shopping", "Alışveriş", "marketplace_retail", ["amazon", "hepsiburada", "trendyol", "n11", "ciceksepeti", "çiçeksepeti", "bkmkitap", "kitap"]),
    ("accommodation", "Konaklama", "hotel_stay", ["hotel", "otel", "booking", "airbnb", "konaklama"]),
    ("education", "Eğitim", "education_course", ["üniversite", "universite", "udemy", "coursera", "kurs", "dershane", "dil okulu", "eğitim"]),
    ("insurance", "Sigorta", "insurance_premium", ["sigorta", "kasko", "dask", "bes", "bireysel emeklilik", "poliçe", "police"]),
    ("utilities_tax", "Fatura ve Vergi", "tax_public_payment", ["vergi", "daire(?:si)?", "sgk", "fatura", "elektrik", "doğalgaz", "dogalgaz", "igdas", "iski", "su fatura"]),
    ("finance", "Bankacılık", "banking_fee_atm", ["atm", "nakit çekme", "nakit cekme", "para çekme", "para cekme", "havale", "eft", "fast", "komisyon", "işletim ücreti", "isletim ucreti", "faiz", "aidat"]),
    ("payment", "Kart Ödemesi", "card_payment", ["kart ödeme", "kart odeme", "ödemeniz için teşekkür", "odemeniz icin tesekkur"]),
    ("other", "Diğer", "uncategorized", []),
]
# Examples of each subcategory.
EXAMPLES = {
    "flight_transport": ["PEGASUS", "TURKISH AIRLINES", "THY", "WIZZ AIR", "SUNEXPRESS", "AJET", "OBILET.COM", "ENUYGUN", "uçak bileti", "otobüs bileti"],
    "delivery_restaurant": ["TRENDYOL YEMEK", "YEMEKSEPETI", "GETIR YEMEK", "MIGROS YEMEK", "STARBUCKS", "MCDONALDS", "BURGER KING", "DOMINOS", "KFC", "RESTAURANT", "CAFE"],
    "supermarket": ["MIGROS", "BIM", "A101", "SOK", "CARREFOURSA", "MACROCENTER", "METRO MARKET", "FILE", "HAKMAR", "TARImkredI KOOP", "GETIR", "BANABI"],
    "gas_station": ["SHELL", "BP", "OPET", "PETROL OFISI", "TOTAL", "AYTEMIZ", "LUKOIL", "MOIL", "akaryakit"],
    "ride_hailing_transit": ["UBER", "BITAKSI", "MARTI", "IETT", "METRO ISTANBUL", "ISTANBULKART", "HGS", "OGS", "OTOPARK", "ISPARK"],
    "pharmacy_medical": ["ECZANE", "HASTANE", "ACIBADEM", "MEDICAL PARK", "MLP CARE", "MEMORIAL", "LABORATUVAR", "DIS KLINIGI"],
    "apparel": ["LC WAIKIKI", "ZARA", "H&M", "KOTON", "DEFACTO", "MAVI", "BOYNER", "PULL&BEAR", "BERSHKA", "DECATHLON"],
    "gaming_digital": ["PLAYSTATION", "STEAM", "NETFLIX", "SPOTIFY", "BLUTV", "EXXEN", "DISNEY PLUS", "YOUTUBE PREMIUM"],
    "mobile_internet": ["TURKCELL", "VODAFONE", "TURK TELEKOM", "TURKNET", "SUPERONLINE", "MILLENICOM"],
    "digital_subscription": ["ICLOUD", "GOOGLE ONE", "GOOGLE STORAGE", "MICROSOFT 365", "ADOBE", "AMAZON PRIME", "LINKEDIN PREMIUM"],
    "electronics": ["MEDIA MARKT", "MEDIAMARKT", "TEKNOSA", "VATAN BILGISAYAR", "APPLE STORE"],
    "marketplace_retail": ["AMAZON", "TRENDYOL", "HEPSIBURADA", "N11", "CICEKSEPETI", "BKMKITAP", "KITAP"],
    "hotel_stay": ["HOTEL", "OTEL", "BOOKING", "AIRBNB", "KONAKLAMA"],
    "education_course": ["UNIVERSITE", "UDEMY", "KURS", "DIL OKULU", "OKUL TAKSIT"],
    "insurance_premium": ["SIGORTA", "KASKO", "DASK", "BES", "TRAFIK SIGORTASI"],
    "tax_public_payment": ["VERGI DAIRESI", "SGK", "ELEKTRIK FATURASI", "SU FATURASI", "DOGALGAZ", "IGDAS"],
    "banking_fee_atm": ["ATM NAKIT CEKME", "PARA CEKME", "HAVALE", "EFT", "FAST", "KOMISYON", "HESAP ISLETIM UCRETI", "FAIZ"],
    "card_payment": ["KART ODEMESI", "ODEMENIZ ICIN TESEKKUR EDERIZ"],
    "uncategorized": ["OTHER"],
}
INCOME = ("income_or_refund", "Gelir ve İade")

# Flags of a transaction and what each adds to its anomaly score, with the words of the message.
FLAG_BONUS = {"foreign_currency_transaction": 0.12, "installment_transaction": 0.05, "low_source_confidence": 0.18, "source_validation_warning": 0.18}
FLAG_WORDS = {
    "unusually_high_amount": "Alışılmışın üzerinde tutar", "foreign_currency_transaction": "Yabancı para işlemi", "installment_transaction": "Taksitli işlem",
    "low_source_confidence": "Düşük veri güveni", "source_validation_warning": "Doğrulama uyarısı", "pyod_outlier_score": "İstatistiksel sapma",
}
LOW_CONFIDENCE, MIN_ECDF_ROWS, ECDF_CUTOFF, ROBUST_CUTOFF, ROBUST_Z = 0.70, 8, 0.40, 0.25, 3.5

# Routes of input kinds.
ROUTES = {
    "real_pdf": "pdf.real.extract_text", "scanned_pdf": "pdf.scanned.ocr", "hybrid_pdf": "pdf.hybrid.extract_and_ocr", "screenshot": "image.screenshot.ocr",
    "camera_photo": "image.camera_photo.preprocessing", "unknown": "manual_review", "unsupported": "unsupported",
}
NEEDS_OCR = ["scanned_pdf", "hybrid_pdf", "screenshot", "camera_photo"]
NEEDS_PREPROCESSING = ["scanned_pdf", "hybrid_pdf", "camera_photo"]
VARIANT_PRIORITY = {
    "enhanced_grayscale": 100, "ocr_grayscale": 100, "rendered_original": 90, "normalized_original": 90, "original": 80, "color": 75, "grayscale": 70,
    "gray": 70, "thresholded": 55, "threshold": 55, "binary": 50, "bw": 50,
}
ALLOWED_MIME = ["application/pdf", "image/jpeg", "image/png", "image/webp", "image/heic", "image/heif"]
MAX_UPLOAD_BYTES = 50 * 1024 * 1024

# Words of a question and its intent, first match wins.
INTENTS = [("category_question", ["kategori", "en çok"]), ("anomaly_question", ["anomali", "şüpheli"]), ("installment_question", ["taksit", "kaç ay"]), ("forecast_question", ["tahmin", "gelecek ay"])]

# Sentences of reports and answers.
SAYINGS = {
    "top_category": "Harcamalarınızın en büyük bölümü %s kategorisinde (%%%s).",
    "profile": "Harcama profiliniz: %s.",
    "some_anomalies": "İncelemeye değer %d işlem dikkat çekiyor.",
    "no_anomaly": "Dikkat çeken olağan dışı bir işlem görünmüyor.",
    "forecast": "Gelecek dönem için tahmini harcamanız yaklaşık %s %s.",
    "installment": "Planladığınız alışveriş için %d ay taksit uygun bir seçenek olarak öne çıkıyor.",
    "answer_category": "En çok harcama yaptığınız kategori %s; bu kategori toplam harcamanızın yaklaşık %%%s'ini oluşturuyor.",
    "answer_anomalies": "İncelemenizde fayda olan %d işlem var. En dikkat çekeni: %s",
    "answer_no_anomaly": "Olağan dışı görünen bir işlem tespit edilmedi.",
    "answer_installment": "Planladığınız alışveriş için %d ay taksit uygun görünüyor.",
    "answer_no_installment": "Taksit önerisi sunabilmem için alışveriş tutarını (purchase_scenario) paylaşmanız gerekiyor.",
    "answer_no_forecast": "Tahmin üretebilmem için yeterli geçmiş dönem verisi yok.",
    "answer_general": "Size kategori dağılımınız, harcama profiliniz, dikkat çeken işlemler, harcama tahmininiz ve taksit seçenekleri hakkında yardımcı olabilirim.",
}

# Sentences of observations, explanations and chat contexts, and statuses.
OBSERVATIONS = {
    "no_spending": "Analiz için harcama işlemi bulunamadı.",
    "heavy_category": "Harcama tutarının %%%s bölümü %s kategorisinde yoğunlaşıyor.",
    "installments": "İşlemlerin %%%s bölümü taksitli.",
    "foreign": "İşlemlerin %%%s bölümü yabancı para işlemi içeriyor.",
    "large_purchase": "En yüksek harcama, ortalama işlem tutarının belirgin üzerinde.",
    "balanced": "Belirgin tek bir harcama davranışı yoğunluğu tespit edilmedi.",
    "no_debits": "Anomali analizi için harcama işlemi bulunamadı.",
    "anomalies": "%d işlem inceleme gerektirebilecek anomali sinyali taşıyor.",
    "no_anomalies": "Belirgin bir anomali sinyali tespit edilmedi.",
    "few_rows": "PyOD modeli için yeterli geçmiş işlem olmadığı için istatistiksel fallback kullanıldı.",
    "no_months": "Forecast için harcama verisi bulunamadı.",
    "few_months": "Yeterli dönem olmadığından ağırlıklı hareketli ortalama kullanıldı.",
}
EXPLANATIONS = {
    "not_requested": "Taksit değerlendirmesi için purchase_scenario gönderilmelidir.",
    "insufficient_data": "Satın alma senaryosu için karşılaştırılabilir harcama tahmini bulunamadı.",
    "completed": "%s %s tutarındaki alışveriş için %d ay taksit, aylık %s %s ödemeyle tahmini harcama seviyenize göre %s bir seçenek görünüyor.",
}
RISK_WORDS = {"low": "rahatça karşılayabileceğiniz", "medium": "orta düzeyde zorlayabilecek", "high": "bütçenizi yükleyebilecek"}
CONTEXT = {
    "primary": "- En yoğun harcama kategorisi: %s (toplam harcamanın %%%s'i).",
    "labels": "- Harcama profili: %s.",
    "categories": "- En çok harcanan kategoriler: %s.",
    "anomalies": "- İşaretlenen anomali sayısı: %d.",
    "anomaly": "  - %s: %s %s (%s önem).",
    "forecast": "- Gelecek dönem harcama tahmini: %s %s.",
    "installment": "- Önerilen taksit sayısı: %d ay (risk: %s).",
}
WARNINGS = {
    "low_rows": "low_confidence_source_rows_present", "invalid_rows": "invalid_source_rows_present", "low": "analysis_contains_low_confidence_transactions", "invalid": "analysis_contains_invalid_transactions",
    "no_forecast": "insufficient_forecast_for_installment_recommendation", "no_advice": "recommendation_is_spending_burden_estimate_not_credit_advice",
}
MIN_MODEL_MONTHS, PARTIAL = 6, 0.55

# Image variants of each kind: (variant, purpose, for OCR, operations).
VARIANTS = {
    "screenshot": [("normalized_original", "color_preservation", True, ["normalize_original"]), ("ocr_grayscale", "primary_ocr", True, ["grayscale", "soft_contrast_enhancement"])],
    "camera_photo": [("normalized_original", "color_preservation", True, ["normalize_original"]), ("enhanced_grayscale", "primary_ocr", True, ["grayscale", "deskew", "contrast_enhancement"]), ("thresholded", "secondary_ocr", True, ["grayscale", "deskew", "contrast_enhancement", "adaptive_threshold", "small_noise_removal"])],
    "scanned_pdf": [("rendered_original", "fallback_ocr", True, ["rendered_original"]), ("enhanced_grayscale", "primary_ocr", True, ["grayscale", "deskew", "contrast_enhancement"]), ("thresholded", "secondary_ocr", True, ["grayscale", "deskew", "contrast_enhancement", "adaptive_threshold", "small_noise_removal"])],
}
NATIVE_OPERATIONS = ["preserve_original_pdf", "skip_image_rendering", "skip_ocr"]
PREVIEW = ("page_preview", "debug_preview", False, ["grayscale_preview", "light_contrast_enhancement"])
MAX_VARIANTS = 4
