"""Business rules of the booking domain.

The values under "Fixed values" must equal the source application's for the
results to agree; they are stated plainly, in their natural order.
"""

# ---------------------------------------------------------------------------
# Fixed values (pricing, refunds, currencies, defaults, labels)
# ---------------------------------------------------------------------------

# city -> (peak rate, off-peak rate) per night
CITY_RATES = [
    ("Aberdeen", 140, 70),
    ("Belfast", 130, 70),
    ("Birmingham", 150, 75),
    ("Bristol", 140, 70),
    ("Cardiff", 130, 70),
    ("Edinburgh", 160, 80),
    ("Glasgow", 150, 75),
    ("London", 200, 100),
    ("Manchester", 180, 90),
    ("Newcastle", 120, 70),
    ("Oxford", 180, 90),
    ("Kent", 140, 80),
]
FALLBACK_CITY = "London"  # unknown cities take London's rates

PEAK_MONTHS = (4, 5, 6, 7, 8, 11, 12)
PEAK_NAME = "Peak Season"
OFFPEAK_NAME = "Off-Peak Season"
PEAK_SURCHARGE_RATE = "0.30"
ROOM_TYPE_SURCHARGE_RATE = {"double": "0.20", "family": "0.50"}
GUEST_SURCHARGE_RATE = "0.10"  # double room with 2+ guests
VALID_QUOTE_ROOM_TYPES = ("single", "double", "family")

# (min days, max days, percent, label) for advance-booking discounts
ADVANCE_DISCOUNT_TIERS = [
    (80, 90, 30, "30% (80-90 days in advance)"),
    (60, 79, 20, "20% (60-79 days in advance)"),
    (45, 59, 10, "10% (45-59 days in advance)"),
]
NO_DISCOUNT_LABEL = "No discount"

# (min days until check-in, charge fraction, policy text) for cancellations
REFUND_TIERS = [
    (30, "0.00", "Full refund (cancellation 30+ days before check-in)"),
    (15, "0.25", "75% refund (cancellation 15-29 days before check-in)"),
    (7, "0.50", "50% refund (cancellation 7-14 days before check-in)"),
    (0, "1.00", "No refund (cancellation less than 7 days before check-in)"),
]
REFUND_POLICY_PREFIX = "Cancellation charges apply based on how close to check-in you cancel. "

# currency -> (rate from GBP, symbol)
CURRENCIES = [("GBP", "1.00", "£"), ("USD", "1.27", "$"), ("EUR", "1.17", "€")]
MONEY_FORMAT = "£%.2f"

# room type typed in the add-room form -> (price multiplier, max guests)
ROOM_TYPE_DEFAULTS = [("standard", "1.0", 1), ("double", "1.2", 2), ("family", "1.5", 4)]
ROOM_TYPE_DEFAULT_OTHER = ("1.0", 1)
ROOM_STATUSES = ("available", "booked", "maintenance")

# rooms created with every new hotel:
# (number suffix, type, price factor, capacity, max guests, multiplier, features)
DEFAULT_ROOMS = [
    ("01", "Single", "0.8", 1, 1, "1.0", "Single bed, TV, WiFi, En-suite bathroom"),
    ("02", "Double", "1.0", 2, 2, "1.2", "Double bed, TV, WiFi, Mini-fridge, En-suite bathroom"),
    ("03", "Family", "1.2", 4, 4, "1.5", "Two double beds, TV, WiFi, Mini-fridge, Sofa, En-suite bathroom"),
]

HOTEL_DEFAULT_PRICE = "100.00"
HOTEL_DEFAULT_IMAGE = "default.jpg"
HOTEL_DEFAULT_ADDRESS = "Hotel Address, City, Country"
HOTEL_IMAGE_PREFIX = "images/hotels/"
TEASER_CHARS = 90

PAGE_FIRST = 9
PAGE_NEXT = 8

BOOKING_STATUSES = ("confirmed", "pending", "cancelled")
MESSAGE_STATUSES = ("new", "read", "replied")
ROLES = ("user", "admin")
USERNAME_MIN, USERNAME_MAX = 3, 20
GUEST_NAME_DEFAULT = "Guest"
MEMBER_SINCE_UNKNOWN = "Recently"
GUEST_EMAIL_DOMAIN = "@example.com"

PROFIT_REVENUE_THRESHOLD = 10000
REPORT_TOP_N = 10
RECENT_BOOKINGS_N = 5
MEDALS = ("gold", "silver", "bronze")

# booking-request validation messages (quote path, then create path)
MSG_QUOTE_MISSING = "Missing booking information. Please select dates and room type."
MSG_CREATE_MISSING = "Missing required booking information."
MSG_ROOM_TYPE_INVALID = "Invalid room type selected."
MSG_HOTEL_NOT_FOUND = "Hotel not found."
MSG_NIGHTS_INVALID = "Check-out date must be after check-in date."
MSG_QUOTE_PROCESSING_ERROR = "Error processing booking details. Please try again."
MSG_CREATE_PROCESSING_ERROR = "An error occurred while processing your booking. Please try again."
MSG_ROOM_DELETE_REFUSED = "Cannot delete room with {n} bookings! Please cancel bookings first."
MSG_USER_DELETE_REFUSED = "Cannot delete user with {n} bookings!"
MSG_CANCEL_NOT_ALLOWED = "Booking not found or you do not have permission to cancel it"
MSG_CANCEL_WRONG_STATUS = "Cannot cancel booking with status: "
MSG_OWN_STATUS = "Cannot modify your own account status"
MSG_OWN_ROLE = "Cannot modify your own role"
MSG_USER_NOT_FOUND = "User not found"
MSG_ROLE_DATA_MISSING = "Missing required data"
MSG_ROLE_UNKNOWN = "Invalid role"

# replies of this library for what the source has no words for
MSG_BOOKING_UNKNOWN = "booking not found"
MSG_COMMAND_UNKNOWN = "unknown command"
MSG_PROFILE_HELD = "username or email already in use"
MSG_PROFILE_TAKEN_IN_BATCH = "username or email taken earlier in the batch"

# account validation messages, in the order they are reported
MSG_USERNAME_REQUIRED = "Username is required"
MSG_USERNAME_LENGTH = "Username must be 3-20 characters"
MSG_EMAIL_REQUIRED = "Email is required"
MSG_EMAIL_FORMAT = "Invalid email format"
MSG_ROLE_INVALID = "Invalid role selected"
MSG_ACCOUNT_EXISTS = "Account already exists!"
MSG_TAKEN = "Email or username already exists"

# the collation by which the store compares text: accents and case make no difference
STORE_COLLATION = "UNICODE_CI_AI"
