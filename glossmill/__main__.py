from glossmill.plans.programs import main

main()
