from headwater.main import main

main()
