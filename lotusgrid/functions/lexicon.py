"""Word lists and patterns of the news classifier."""

# Tokens of vehicles in slugs.
VEHICLE_TOKENS = ["xe", "oto", "moto", "motor", "container", "tau"]

# Phrases that alone mark a crash.
SAFE_PHRASES = [
    "tai nan giao thong", "va cham giao thong", "lat xe", "xe lat", "mat lai", "dam lien hoan", "tong lien hoan",
    "dam xe", "xe dam", "tong xe", "xe tong",
]

# Phrases that mark a crash beside a vehicle token.
GATED_PHRASES = [
    "tai nan", "va cham", "dam vao", "tong vao", "dam trung", "tong trung", "dam truc dien", "tong truc dien",
    "dam chet", "tong chet", "can chet", "can tu vong", "can qua", "lao xuong", "roi xuong", "hat vang", "chet tai cho",
]

# Parts of a url that exclude it.
SLUG_EXCLUDE = [
    "trao-qua", "chia-se", "tu-thien", "ung-ho", "quyen-gop",
    "hoi-nghi", "hoi-thao", "toa-dam", "ra-quan", "phat-dong",
    "khen-thuong", "tuyen-truyen", "dien-tap", "le-ky-niem",
    "nghi-dinh", "thong-tu", "du-thao", "de-xuat", "quy-hoach",
    "khoi-cong", "khanh-thanh", "thong-xe", "dau-thau",
    "bong-da", "the-thao", "showbiz", "giai-tri",
    "tong-ket", "tong-hop", "tong-kiem-tra", "tong-thong", "tong-bi-thu",
    "tong-cuc", "tong-giam-doc", "tong-thu-ky", "tong-lanh-su", "ho-tong",
    "dinh-dam", "hiep-dam", "dam-o", "dam-duc", "dam-phan", "dam-dao",
    "dam-me", "dam-duoi", "loan-luan",
]

# Districts of the city.
DISTRICTS = [
    "Hoàn Kiếm", "Ba Đình", "Đống Đa", "Hai Bà Trưng", "Tây Hồ", "Cầu Giấy",
    "Thanh Xuân", "Hoàng Mai", "Long Biên", "Nam Từ Liêm", "Bắc Từ Liêm",
    "Hà Đông", "Sơn Tây", "Ba Vì", "Chương Mỹ", "Đan Phượng", "Đông Anh",
    "Gia Lâm", "Hoài Đức", "Mê Linh", "Mỹ Đức", "Phú Xuyên", "Phúc Thọ",
    "Quốc Oai", "Sóc Sơn", "Thạch Thất", "Thanh Oai", "Thanh Trì",
    "Thường Tín", "Ứng Hòa",
]

# Roads, bridges and places of the city; one stands twice and counts twice.
LANDMARKS = [
    "Nguyễn Trãi", "Giải Phóng", "Trường Chinh", "Láng Hạ", "đường Láng",
    "Xuân Thủy", "Phạm Văn Đồng", "Võ Chí Công", "Nguyễn Văn Cừ",
    "Ngô Gia Tự", "Đại lộ Thăng Long", "Khuất Duy Tiến", "Lê Văn Lương",
    "Tố Hữu", "Trần Duy Hưng", "Phạm Hùng", "Lê Đức Thọ", "Hoàng Quốc Việt",
    "Nguyễn Xiển", "Nguyễn Khoái", "Minh Khai", "Tam Trinh", "Lĩnh Nam",
    "Ngọc Hồi", "Phan Trọng Tuệ", "Giải Phóng", "Kim Mã", "Liễu Giai",
    "Âu Cơ", "Nghi Tàm", "Yên Phụ", "Thanh Niên", "Xã Đàn", "Ô Chợ Dừa",
    "Cầu Giấy", "Cầu Chương Dương", "cầu Vĩnh Tuy", "cầu Thanh Trì",
    "cầu Nhật Tân", "cầu Long Biên", "cầu Thăng Long", "cầu Vĩnh Thịnh",
    "hầm chui Kim Liên", "hầm chui Thanh Xuân", "Ngã Tư Sở", "Ngã Tư Vọng",
    "Vành đai 3", "Vành đai 2", "Vành đai 2,5", "Vành đai 4",
    "Bến xe Mỹ Đình", "Bến xe Giáp Bát", "Bến xe Nước Ngầm",
    "Bến xe Gia Lâm", "sân bay Nội Bài", "Times City", "Royal City",
    "Linh Đàm", "Định Công", "Đại Kim", "Mỹ Đình", "Mễ Trì", "Trung Hòa",
]

# Other provinces.
PROVINCES = [
    "An Giang", "Bà Rịa", "Vũng Tàu", "Bắc Giang", "Bắc Kạn", "Bạc Liêu",
    "Bắc Ninh", "Bến Tre", "Bình Định", "Bình Dương", "Bình Phước",
    "Bình Thuận", "Cà Mau", "Cần Thơ", "Cao Bằng", "Đà Nẵng", "Đắk Lắk",
    "Đắk Nông", "Điện Biên", "Đồng Nai", "Đồng Tháp", "Gia Lai",
    "Hà Giang", "Hà Nam", "Hà Tĩnh", "Hải Dương", "Hải Phòng", "Hậu Giang",
    "Hòa Bình", "Hưng Yên", "Khánh Hòa", "Kiên Giang", "Kon Tum",
    "Lai Châu", "Lâm Đồng", "Lạng Sơn", "Lào Cai", "Long An", "Nam Định",
    "Nghệ An", "Ninh Bình", "Ninh Thuận", "Phú Thọ", "Phú Yên",
    "Quảng Bình", "Quảng Nam", "Quảng Ngãi", "Quảng Ninh", "Quảng Trị",
    "Sóc Trăng", "Sơn La", "Tây Ninh", "Thái Bình", "Thái Nguyên",
    "Thanh Hóa", "Thừa Thiên", "Tiền Giang", "TP.HCM", "TP HCM",
    "Hồ Chí Minh", "Trà Vinh", "Tuyên Quang", "Vĩnh Long", "Vĩnh Phúc",
    "Yên Bái", "Huế",
]

CITY = "hà nội"

# Patterns over article text; the first letter case is ignored unless noted.
TRANSFER = r"(?:chuyển|đưa|cấp cứu|điều trị|chuyển tuyến)\s+(?:lên|ra|về|đến|tới)\s+(?:[^.]{0,40})?(?:Hà Nội|Bệnh viện Việt Đức|Bạch Mai|Việt Đức|Trung ương Quân đội|103|108)"
CRASH_VERB = r"\b(tai nạn giao thông|va chạm|đâm (?:vào|trúng|trực diện|liên hoàn)|tông (?:vào|trúng|trực diện|liên hoàn)|cán (?:qua|trúng|chết)|húc (?:vào|đổ)|lật (?:xe|nghiêng)|xe (?:lật|lao|mất lái)|mất lái|lao xuống|rơi xuống|kẹt dưới (?:gầm|bánh))\b"
VEHICLE = r"\b(xe máy|mô ?tô|xe gắn máy|ô ?tô|xe con|xe tải|xe ben|xe bồn|container|xe đầu kéo|xe buýt|xe bus|xe khách|xe giường nằm|xe đạp|xe ba gác|người đi bộ|xe cứu thương|xe cứu hỏa)\b"
OUTCOME = r"\b(tử vong|thiệt mạng|chết tại chỗ|bị thương|nguy kịch|đa chấn thương|hư hỏng nặng|biến dạng)\b"
AGGREGATE = r"\b(trong (?:tháng|quý|năm|kỳ nghỉ|dịp)|tổng cộng|thống kê cho thấy|so với cùng kỳ|cả nước xảy ra|trung bình mỗi (?:ngày|tháng)|số vụ tai nạn (?:giảm|tăng)|nghị định|thông tư|dự thảo|hội nghị|hội thảo|tọa đàm|ra quân|phát động|trao quà|chia sẻ với|ủng hộ|quyên góp|khen thưởng|diễn tập)\b"
EXACT_TIME = r"(?:khoảng\s+)?\b([01]?\d|2[0-3])\s*(?:h|giờ)\s*([0-5]?\d)?\b"
VAGUE_TIME = r"\b(rạng sáng|sáng sớm|sáng|giữa trưa|trưa|chiều tối|chiều|tối|đêm|khuya|nửa đêm)\b"
DATE = r"\b(?:ngày\s+)?([0-3]?\d)[/\-.]([01]?\d)(?:[/\-.](20\d{2}))?\b"  # letter case counts
LOC_PRECISE = r"\b(ngã\s*(?:tư|ba|năm|sáu|bảy)|nút giao|vòng xuyến|cầu vượt|hầm chui|km\s*\d+|số\s+\d+\s+(?:phố|đường)|trước\s+(?:số|cửa))\b"
LOC_COARSE = r"\b(quận|huyện|thị xã|phường|xã)\s+[A-ZĐÀ-Ỹ]"
STREET = r"\b(?:đường|phố|đại lộ|quốc lộ|cầu)\s+[A-ZĐÀ-Ỹ]"  # letter case counts
CASUALTY = r"\b(tử vong|thiệt mạng|chết tại chỗ|bị thương|nguy kịch|cấp cứu|thương vong)\b"
CASUALTY_NUMBER = r"\b(\d+)\s*(?:người\s+)?(tử vong|thiệt mạng|bị thương)\b"
WEATHER = r"\b(trời mưa|mưa lớn|mưa to|đường trơn|sương mù|ngập nước|trời tối)\b"
VEHICLE_CLASSES = {
    "motorcycle": r"xe máy|mô\s?tô|xe gắn máy|xe ôm",
    "car": r"ô\s?tô con|xe con|xe ô\s?tô(?! tải)|xe 4 chỗ|xe 7 chỗ",
    "truck": r"xe tải|xe ben|xe trộn bê\s?tông|xe bồn",
    "container": r"container|xe đầu kéo|xe siêu trường",
    "bus": r"xe buýt|xe bus",
    "coach": r"xe khách|xe giường nằm",
    "bicycle": r"xe đạp",
    "pedestrian": r"người đi bộ|người đi đường bị|sang đường",
}

# Reject reasons.
NO_VERB, NO_VEHICLE, IS_AGGREGATE, AREA = "khong co dong tu va cham", "khong nhac phuong tien", "tin tong hop/chinh sach/su kien", "dia_ban:"

# Highway tags.
NON_VEHICLE_HIGHWAYS = [
    "bridleway", "bus_stop", "construction", "corridor", "cycleway", "elevator",
    "footway", "path", "pedestrian", "platform", "proposed", "raceway", "steps",
]
ROAD_CLASSES = {"primary": "primary", "primary_link": "primary", "secondary": "secondary", "secondary_link": "secondary", "residential": "residential"}
MAJOR_HIGHWAYS = ["motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link", "secondary", "secondary_link"]
