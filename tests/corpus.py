"""An invented two-batch corpus in which every lifecycle shape occurs."""

FIRST = """message_id,timestamp,sender,message
A01,2026-10-01 09:00:00,Project Lead,Can you review the vendor contract before 2026-10-20?
A02,2026-10-01 09:10:00,Mira,Please submit the travel claim by 2026-10-15.
A03,2026-10-01 09:20:00,Ops Desk,Your OTP is 481 516. It expires soon.
A04,2026-10-01 09:30:00,Promotions,"Half price on boots. Use code SAVE30, flat 20% discount."
A05,2026-10-01 09:40:00,Noor,"Calendar update: fire drill, 2026-10-12 at 9:30, Main Hall."
A06,2026-10-01 09:50:00,Noor,"For my profile, I prefer written updates."
A07,2026-10-01 10:00:00,Sam,The canteen is closed tomorrow.
A08,2026-10-01 10:10:00,Sam,I need you to renew the safety badge by 2026-10-30.
"""
SECOND = """message_id,timestamp,sender,message
B01,2026-10-05 09:00:00,Mira,Can you share an update on review the vendor contract?
B02,2026-10-05 09:10:00,Mira,Follow-up: any update on the vendor contract?
B03,2026-10-06 09:00:00,Sam,Update: review the vendor contract has been completed.
B04,2026-10-06 09:10:00,Sam,"The vendor contract might already be done, but I am not completely sure."
B05,2026-10-07 09:00:00,Mira,Any progress on the item concerning the vendor contract?
B06,2026-10-07 09:10:00,Noor,The fire drill has been moved to 2026-10-14 at 11:00.
B07,2026-10-07 09:20:00,Noor,"The date for the fire drill stays the same, but the time is now 15:45."
B08,2026-10-08 09:00:00,Project Lead,The deadline to renew the safety badge is now 2026-10-09. Treat this as urgent.
B09,2026-10-08 09:10:00,Sam,The travel claim has been cancelled.
B10,2026-10-08 09:20:00,Sam,"The deadline may be Tuesday, or it may be Thursday."
B11,2026-10-08 09:30:00,Lee,You can contact me on 70155 28643 after six.
B12,2026-10-08 09:40:00,Lee,I will send the login details separately.
"""
SECRETS = ["481 516", "70155 28643"]
