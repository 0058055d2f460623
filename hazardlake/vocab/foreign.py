"""Fixed failure phrases in Hindi, Bengali and Assamese.

Each list is a fixed value: the phrases of a rule.  A phrase
carries its own negation, so a match always means a failed control.
"""

# Fixed values.
HI = {
    'Energy Isolation': [
        'आइसोलेशन नहीं',
        'आइसोलेशन के बिना',
        'बिना आइसोलेशन',
        'लॉकआउट नहीं',
        'बिना लॉकआउट',
        'आइसोलेट नहीं',
        'बिना आइसोलेट',
        'डिप्रेसराइज़ नहीं',
        'बिना डिप्रेसराइज़',
        'स्विच ऑफ नहीं',
        'बिजली बंद नहीं',
    ],
    'Confined Space Entry': [
        'गैस टेस्ट नहीं',
        'गैस टेस्ट के बिना',
        'बिना गैस टेस्ट',
        'गैस जांच नहीं',
        'बिना गैस जांच',
        'अटेंडेंट नहीं',
        'बिना अटेंडेंट',
        'स्टैंडबाय नहीं',
    ],
    'Hot Work Safety': [
        'हॉट वर्क परमिट नहीं',
        'बिना हॉट वर्क परमिट',
        'फायर वॉच नहीं',
        'बिना फायर वॉच',
        'वेल्डिंग परमिट नहीं',
    ],
    'Working at Height': [
        'हार्नेस नहीं',
        'बिना हार्नेस',
        'सेफ्टी बेल्ट नहीं',
        'बिना सेफ्टी बेल्ट',
    ],
    'Line of Fire': [
        'लोड के नीचे',
        'भार के नीचे',
    ],
    'Safe Mechanical Lifting': [
        'बैंक्समैन नहीं',
        'बिना बैंक्समैन',
    ],
    'Driving Safety': [
        'स्पॉटर नहीं',
        'बिना स्पॉटर',
    ],
    'Toxic Gas Safety': [
        'गैस डिटेक्टर नहीं',
        'बिना गैस डिटेक्टर',
        'डिटेक्टर नहीं',
    ],
    'Bypassing Safety Controls': [
        'गार्ड हटा दिया',
        'इंटरलॉक बायपास',
        'बायपास कर दिया',
    ],
    'Work Authorization': [
        'बिना परमिट',
        'परमिट नहीं',
        'बिना अनुमति',
    ],
}

# Fixed values.
HI_LATN = {
    'Energy Isolation': [
        'isolation nahi',
        'isolate nahi',
        'bina isolate',
        'bina isolation',
        'lockout nahi',
        'lock nahi laga',
        'tagout nahi',
        'bina lockout',
        'bina depressurize',
        'depressurize nahi',
        'pressure release nahi',
        'switch off nahi',
        'bina switch off',
        'power band nahi',
        'bina power band',
        'still pressurize tha',
    ],
    'Confined Space Entry': [
        'bina gas test',
        'gas test nahi',
        'gas testing nahi',
        'koi gas test',
        'bina gas checking',
        'gas checking nahi',
        'bina attendant',
        'attendant nahi',
        'bina standby',
        'standby nahi',
        'bina gas test ke',
    ],
    'Hot Work Safety': [
        'bina hot work permit',
        'hot work permit nahi',
        'bina welding permit',
        'welding permit nahi',
        'bina fire watch',
        'fire watch nahi',
    ],
    'Working at Height': [
        'bina harness',
        'harness nahi',
        'safety belt nahi',
        'bina safety belt',
        'fall protection nahi',
        'bina fall protection',
        'bina safety net',
    ],
    'Line of Fire': [
        'load ke neeche',
        'bhar ke neeche khada',
        'suspended load ke neeche',
        'crane ke neeche',
    ],
    'Safe Mechanical Lifting': [
        'bina banksman',
        'banksman nahi',
        'capacity se zyada load',
        'bina lifting plan',
    ],
    'Driving Safety': [
        'bina spotter',
        'spotter nahi',
        'speed limit se zyada',
    ],
    'Toxic Gas Safety': [
        'gas detector nahi',
        'detector nahi pehna',
        'bina gas detector',
        'bina h2s detector',
    ],
    'Bypassing Safety Controls': [
        'guard hata diya',
        'guard remove kar diya',
        'interlock bypass kar diya',
        'bypass kar diya',
        'emergency stop hata diya',
    ],
    'Work Authorization': [
        'bina permit',
        'permit nahi',
        'bina ptw',
        'permit ke bina',
        'bina work permit',
        'work permit nahi',
    ],
}

# Fixed values.
BN = {
    'Energy Isolation': [
        'আইসোলেশন ছাড়া',
        'আইসোলেশন ছাড়াই',
        'আইসোলেশন করা হয়নি',
        'লকআউট ছাড়া',
        'লকআউট করা হয়নি',
        'প্রেশার রিলিজ ছাড়া',
        'ডিপ্রেসারাইজ করা হয়নি',
        'এনার্জি আইসোলেট করা হয়নি',
    ],
    'Confined Space Entry': [
        'গ্যাস টেস্ট ছাড়া',
        'গ্যাস টেস্ট ছাড়াই',
        'গ্যাস টেস্ট করা হয়নি',
        'গ্যাস পরীক্ষা ছাড়া',
        'অ্যাটেন্ডেন্ট ছিল না',
        'স্ট্যান্ডবাই ছিল না',
        'গ্যাস টেস্ট না করে',
    ],
    'Hot Work Safety': [
        'ফায়ার ওয়াচ ছিল না',
        'হট ওয়ার্ক পারমিট ছাড়া',
        'ওয়েল্ডিং পারমিট ছাড়া',
    ],
    'Working at Height': [
        'হারনেস ছাড়া',
        'সেফটি বেল্ট ছাড়া',
        'ফল প্রোটেকশন ছাড়া',
        'হারনেস পরা ছিল না',
    ],
    'Line of Fire': [
        'ঝুলন্ত লোডের নিচে',
        'লোডের নিচে দাঁড়িয়ে',
    ],
    'Safe Mechanical Lifting': [
        'ব্যাংকসম্যান ছাড়া',
        'ব্যাংকসম্যান ছিল না',
        'বাইরে লোড চার্ট ছাড়া',
    ],
    'Driving Safety': [
        'স্পটার ছাড়া',
        'স্পটার ছিল না',
    ],
    'Toxic Gas Safety': [
        'গ্যাস ডিটেক্টর ছাড়া',
        'গ্যাস ডিটেক্টর ছিল না',
    ],
    'Bypassing Safety Controls': [
        'গার্ড সরিয়ে দেওয়া',
        'ইন্টারলক বাইপাস',
    ],
    'Work Authorization': [
        'পারমিট ছাড়া',
        'পারমিট ছিল না',
    ],
}

# Fixed values.
BN_LATN = {
    'Energy Isolation': [
        'isolation chara',
        'isolation kora hoyni',
        'lockout chara',
        'pressure release chara',
        'depressurize kora hoyni',
        'energize chilo',
    ],
    'Confined Space Entry': [
        'gas test chara',
        'gas test hoyni',
        'gas test kora hoyni',
        'attendant chilo na',
        'standby chilo na',
        'gas test na kore',
    ],
    'Hot Work Safety': [
        'fire watch chilo na',
        'hot work permit chara',
        'welding permit chara',
    ],
    'Working at Height': [
        'harness chara',
        'safety belt chara',
        'harness pore chilo na',
        'fall protection chara',
    ],
    'Line of Fire': [
        'load er niche',
        'suspended load er niche',
    ],
    'Safe Mechanical Lifting': [
        'banksman chara',
        'banksman chilo na',
        'load chart chara',
    ],
    'Driving Safety': [
        'spotter chara',
        'spotter chilo na',
    ],
    'Toxic Gas Safety': [
        'gas detector chara',
        'detector pora hoyni',
    ],
    'Bypassing Safety Controls': [
        'guard khule diye',
        'interlock bypass kore',
    ],
    'Work Authorization': [
        'permit chara',
        'permit chilo na',
    ],
}

# Fixed values.
AS = {
    'Energy Isolation': [
        'আইছোলেছন নকৰাকৈ',
        'আইছোলেছন নকৰি',
        'লকআউট নকৰাকৈ',
        'প্ৰেছাৰ ৰিলিজ নকৰাকৈ',
    ],
    'Confined Space Entry': [
        'গেছ টেষ্ট নকৰাকৈ',
        'গেছ টেষ্ট নকৰি',
        'গেছ টেষ্ট কৰা নাছিল',
        'এটেণ্ডেণ্ট নাছিল',
    ],
    'Hot Work Safety': [
        'ফায়াৰ ৱাচ নাছিল',
        'হট ৱৰ্ক পাৰ্মিট নাছিল',
    ],
    'Working at Height': [
        'হাৰ্নেছ নিপিন্ধাকৈ',
        'ছেফটি বেল্ট নিপিন্ধাকৈ',
        'হাৰ্নেছ নাছিল',
    ],
    'Safe Mechanical Lifting': [
        'বেংকছমেন নাছিল',
        'বেংকছমেন নকৰাকৈ',
    ],
    'Toxic Gas Safety': [
        'গেছ ডিটেক্টৰ নাছিল',
        'গেছ ডিটেক্টৰ নিপিন্ধাকৈ',
    ],
    'Work Authorization': [
        'পাৰ্মিট নাছিল',
        'পাৰ্মিট অবিহনে',
    ],
}

# Fixed values.
AS_LATN = {
    'Energy Isolation': [
        'isolation nokori',
        'lockout nokora',
        'pressure release nokora',
    ],
    'Confined Space Entry': [
        'gas test nokori',
        'gas test nokorakoi',
        'attendant nai thakil',
        'standby nai',
    ],
    'Hot Work Safety': [
        'fire watch nai thakil',
        'fire watch nai',
    ],
    'Working at Height': [
        'harness nipindhakoi',
        'harness nai',
    ],
    'Toxic Gas Safety': [
        'gas detector nai',
        'detector nipindha nai',
    ],
    'Work Authorization': [
        'permit nai thakil',
        'permit nai',
    ],
}

# Equipment terms.
EQUIPMENT_TERMS = {
    "Pipeline": ["पाइपलाइन", "পাইপলাইন", "পাইপলাইনখন", "पाइप", "পাইপ"],
    "Vessel / Tank": ["टैंक", "टंकी", "ট্যাংক", "টেংকি", "টেংক", "টাংকি"],
    "Crane": ["क्रेन", "ক্রেন", "ক্ৰেন"],
    "Ladder": ["सीढ़ी", "सिढी", "মই", "মইখন", "সিড়ি"],
    "Scaffolding": ["स्कैफोल्ड", "স্ক্যাফোল্ডিং", "স্কাফল্ডিং"],
    "Generator": ["जनरेटर", "জেনারেটর"],
    "Valve": ["वाल्व", "ভালভ"],
    "Hose": ["होज़", "হোস", "পাইপ"],
    "Electrical panel": ["पैनल", "প্যানেল"],
    "Pump": ["पंप", "পাম্প"],
}

# Words that show which language a Latin text is written in.
ROMAN_MARKERS = {
    "hi-latn": ["nahi", "kiya", "kiye", "karke", "bina", "shuru", "gaya", "ghus", "andar", "upar", "neeche", "hata", "laga", "tha", "hai", "raha"],
    "bn-latn": ["chara", "hoyni", "kora", "kore", "chilo", "na kore", "hoyeche", "dhuke", "khola hoyni"],
    "as-latn": ["nokori", "nokora", "nokorakoi", "nipindhakoi", "nai thakil", "thakil", "hole"],
}

# Lexicon order (script first, romanised second) and labels.
PHRASES = [
    ("hi", HI), ("hi", HI_LATN),
    ("bn", BN), ("bn", BN_LATN),
    ("as", AS), ("as", AS_LATN),
]
LANGUAGE_LABELS = {
    "en": "English",
    "hi": "Hindi",
    "hi-latn": "Hindi (romanised)",
    "bn": "Bengali",
    "bn-latn": "Bengali (romanised)",
    "as": "Assamese",
    "as-latn": "Assamese (romanised)",
}
